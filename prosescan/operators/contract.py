"""What a rewrite is told: strategy, rules to fix, content to keep, budget, as one struct per document."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosescan.functions import text as T

SHORT = 240
# Budget and least scores of a rewrite.
PASSES, RETRIES = 2, 1
LEAST = {"preservation_score": 0.9, "anti_ai_score": 0.7, "voice_score": 0.6, "behavior_score": 0.8}


def inferred_mode(text: Column, mode: Column | None = None) -> Column:
    """The declared mode unless it is null or 'unknown', else technical for code, chat for a short question, unknown otherwise."""
    bare = T.trim_all(text)
    guess = F.when(bare.rlike(r"```|`[^`\n]+`"), "technical").when((F.char_length(bare) <= SHORT) & bare.rlike("[?？]"), "chat").otherwise("unknown")
    return F.coalesce(F.nullif(mode, F.lit("unknown")), guess) if mode is not None else guess


def strategy(language: Column, mode: Column, short: Column, profile: Column) -> Column:
    """The first strategy whose conditions hold."""
    chat, prose = mode == "chat", mode.isin("prose", "unknown")
    return (
        F.when(profile & chat, "personal-voice-chat").when(profile, "personal-voice-writing")
        .when(chat & (language == "zh") & short, "zh-chat").when(chat & (language == "en") & short, "en-chat").when(chat, "chat-long-turn")
        .when((language == "zh") & prose, "zh-prose").when((language == "en") & prose, "en-prose")
        .when(mode == "formal", "formal").when(mode == "technical", "technical").when(mode == "public", "public").otherwise("default")
    )


def with_route(rows: DataFrame, text: Column, mode: Column | None = None, profile: Column | None = None) -> DataFrame:
    """Rows with language, mode, short and strategy of their text."""
    rows = rows.withColumns({"language": T.language(text), "mode": inferred_mode(text, mode), "short": F.char_length(T.trim_all(text)).between(1, SHORT), "profile": profile if profile is not None else F.lit(False)})
    return rows.withColumn("strategy", strategy(F.col("language"), F.col("mode"), F.col("short"), F.col("profile"))).drop("profile")


def routed(docs: DataFrame, doc_id: str, text: str, mode: str | None = None, profile: Column | None = None) -> DataFrame:
    """(doc_id, language, mode, short, strategy) of every text."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), body.alias("text"), (F.col(mode) if mode else F.lit(None).cast("string")).alias("declared"), (profile if profile is not None else F.lit(False)).alias("has_profile"))
    return with_route(rows, F.col("text"), F.col("declared"), F.col("has_profile")).select("doc_id", "language", "mode", "short", "strategy")


#: Fields of a contract, for reading it back.
CONTRACT = (
    "strategy string, language string, mode string, objective string, rules array<struct<rule_id:string,severity:int,guidance:string,detector_id:string>>, required array<string>, forbidden array<string>, "
    "protected array<struct<kind:string,value:string,occurrences:int,exact:boolean>>, behaviors array<string>, budget struct<passes:int,retries:int>, minimums map<string,double>"
)


def contracts(rows: DataFrame, objective: str = "Rewrite the text without its tells and keep what it says.", guidance: dict[str, str] | None = None, required: Sequence[str] = (), forbidden: Sequence[str] = (), behaviors: Sequence[str] = ()) -> DataFrame:
    """(doc_id, strategy, n_rules, n_protected, contract) of rows (doc_id, strategy, language, mode, merged, items): all rules, the gravest first, with their guidance, and all items to keep in order, with budget and minimums, as JSON.

    ``behaviors`` are told for chats only. Nothing is joined: what a contract needs stands in the text's row.
    """
    told = F.create_map(*[x for k, v in (guidance or {}).items() for x in (F.lit(k), F.lit(v))]) if guidance else F.create_map().cast("map<string,string>")
    fix = F.transform("merged", lambda f: F.struct(f["rule_id"].alias("rule_id"), f["severity"].alias("severity"), F.coalesce(F.try_element_at(told, f["rule_id"]), F.concat(F.lit("Rewrite the passage so that this tell is absent: "), f["rule_id"])).alias("guidance"), f["detector_id"].alias("detector_id")))
    in_order = F.array_sort(F.transform("items", lambda x: F.struct(x["ord"].alias("ord"), x["value"].alias("value"), x["kind"].alias("kind"), x["occurrences"].alias("occurrences"), x["exact"].alias("exact"))))
    keep = F.transform(in_order, lambda x: F.struct(x["kind"].alias("kind"), x["value"].alias("value"), x["occurrences"].alias("occurrences"), x["exact"].alias("exact")))
    texts = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    manner = F.when(F.col("mode") == "chat", texts(behaviors)).otherwise(texts(()))
    body = F.struct(
        "strategy", "language", "mode", F.lit(objective).alias("objective"), fix.alias("rules"), texts(required).alias("required"), texts(forbidden).alias("forbidden"), keep.alias("protected"), manner.alias("behaviors"),
        F.struct(F.lit(PASSES).alias("passes"), F.lit(RETRIES).alias("retries")).alias("budget"), F.struct(*[F.lit(v).alias(k) for k, v in LEAST.items()]).alias("minimums"),
    )
    return rows.select("doc_id", "strategy", F.size("merged").alias("n_rules"), F.size("items").alias("n_protected"), F.to_json(body).alias("contract"))


def rendered(contract: Column) -> Column:
    """A contract as text for an agent: objective, rules in order, what to do and never to do, what to keep, budget and minimums."""
    c = F.from_json(contract, CONTRACT)

    def part(title: str, items: Column, line: Callable[[Column], Column]) -> Column:
        return F.when(F.size(items) > 0, F.concat(F.lit(f"\n\n## {title}\n\n"), F.array_join(F.transform(items, line), "\n"))).otherwise("")

    dash = lambda x: F.concat(F.lit("- "), x)
    fix = F.transform(c["rules"], lambda r, i: F.concat((i + 1).cast("string"), F.lit(". **"), r["rule_id"], F.lit("** (severity "), r["severity"].cast("string"), F.lit(") — "), r["guidance"], F.lit("\n   - detected by `"), r["detector_id"], F.lit("`")))
    least = F.transform(F.map_entries(c["minimums"]), lambda m: F.concat(m["key"], F.lit(" at least "), m["value"].cast("string")))
    keep = lambda p: F.concat(F.lit("- `"), p["value"], F.lit("` ("), p["kind"], F.lit(", "), F.when(p["exact"], "exact").otherwise("meaning"), F.lit(")"))
    head = F.concat(F.lit("# Rewrite contract\n\nLanguage: "), c["language"], F.lit(" | Mode: "), c["mode"], F.lit(" | Strategy: "), c["strategy"], F.lit("\n\n## Objective\n\n"), c["objective"])
    budget = F.concat(F.lit("\n\n## Budget\n\nAt most "), c["budget"]["passes"].cast("string"), F.lit(" passes and "), c["budget"]["retries"].cast("string"), F.lit(" retry."))
    same = lambda x: x
    return F.concat(head, part("Fix", fix, same), part("Do", c["required"], dash), part("Never do", c["forbidden"], dash), part("Manner", c["behaviors"], dash), part("Keep", c["protected"], keep), budget, part("Checks", least, dash))
