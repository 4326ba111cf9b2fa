"""Findings to scores: suppression, collapse, anti-AI score and composition.

A text's findings are one array of structs (rule_id, detector_id, family, severity, confidence,
evidence) in the text's own row, so that suppression, collapse and scoring are folds within the
row: nothing is joined or shuffled. Unmeasured scores are null and are named in ``unmeasured``; no
score is ever blended with another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosescan.functions import text as T
from prosescan.functions.numbers import clamp_score
from prosescan.plans import lexicon

# Spans in which a finding is exempt, by reason.
EXEMPT = {
    "code": [r"(?s)```.*?```", r"`[^`\n]+`"],
    "quotation": [r"“[^”\n]*”", r"「[^」\n]*」", r'"[^"\n]{2,400}"'],
    "title": [r"《[^》\n]*》", r"(?md)^#{1,6} .*$", rf"{T.LEFT}(?:[A-Z][a-z]+[ \t]+){{2,}}[A-Z][a-z]+{T.RIGHT}"],
    "proper-name": [rf"{T.LEFT}(?:Mr|Mrs|Ms|Dr|Prof|Sir)\.?\s+[A-Z][a-z]+"],
}
BUDGET, CORROBORATION, EVIDENCE_KEPT, CONTRIBUTIONS = 8.0, 2, 20, 50
FORBIDDEN = {"score", "overall", "total", "combined", "blended", "composite"}
FIELDS = ("rule_id", "detector_id", "family", "severity", "confidence", "evidence")


def exempt_spans(text: Column) -> Column:
    """array<struct<start,end,reason>> of code, quotations, titles and names."""
    found = [_with_reason(T.spans(text, p, None), reason) for reason, ps in EXEMPT.items() for p in ps]
    return F.flatten(F.array(*found))


def _with_reason(spans: Column, reason: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(reason).alias("reason")))


def _rules(key: str) -> list[str]:
    return [r["rule_id"] for r in lexicon.rules() if (r["weak_alone"] if key == "weak" else key in r["tags"])]


def judged(found: Column, text: Column, predates: bool = False, weak: list[str] | None = None) -> Column:
    """The findings with ``reason``: null if kept, else why suppressed.

    A finding is exempt if one of its evidences starts in an exempt span; a rule of ``weak`` (those that
    are weak alone) stays only if enough other distinct rules, none of the target voice, stay in the text.
    A text that predates machine writing has nothing suppressed.
    """
    weak, voice = _rules("weak") if weak is None else weak, _rules("voice")
    anchored = F.exists(found, lambda f: F.size(f["evidence"]) > 0)
    none = F.array().cast("array<struct<start:int,end:int,reason:string>>")
    # the earliest span that holds the first evidence which lies in one; texts without evidence aren't searched for spans
    ordered = none if predates else F.when(anchored, F.array_sort(exempt_spans(text))).otherwise(none)

    def inside(f: Column, spans: Column) -> Column:
        each = F.transform(f["evidence"], lambda e: F.get(F.filter(spans, lambda s: (e["start"] >= s["start"]) & (e["start"] < s["end"])), 0)["reason"])
        return F.get(F.filter(each, lambda r: r.isNotNull()), 0)

    def marked(spans: Column) -> Column:
        return F.transform(found, lambda f: F.struct(*[f[c].alias(c) for c in FIELDS], inside(f, spans).alias("inside")))

    def settled(fs: Column) -> Column:
        counted = F.filter(fs, lambda f: f["inside"].isNull() & ~f["rule_id"].isin(*weak, *voice)) if weak or voice else fs
        others = F.size(F.array_distinct(F.transform(counted, lambda f: f["rule_id"])))
        alone = lambda f: f["rule_id"].isin(*weak) & (others < CORROBORATION) if weak and not predates else F.lit(False)
        return F.transform(fs, lambda f: F.struct(*[f[c].alias(c) for c in FIELDS], F.when(f["inside"].isNotNull(), F.concat(F.lit("inside a "), f["inside"])).when(alone(f), F.lit("weak alone")).alias("reason")))

    return T.let(T.let(ordered, marked), settled)


def kept(found: Column) -> Column:
    """The judged findings that weren't suppressed."""
    return F.filter(found, lambda f: f["reason"].isNull())


def collapsed(found: Column) -> Column:
    """One finding per rule, gravest first: the strongest claim by severity, then confidence, then order, with the evidence of all, up to 20, and the greatest confidence."""

    def merged(rule: Column, fs: Column) -> Column:
        own = F.filter(fs, lambda f: f["rule_id"] == rule)
        shown = ("detector_id", "family", "severity", "confidence")
        first = F.get(own, 0)

        def step(a: Column, f: Column) -> Column:
            more = (f["severity"] > a["severity"]) | ((f["severity"] == a["severity"]) & (f["confidence"] > a["confidence"]))
            return F.struct(*[F.when(more, f[c]).otherwise(a[c]).alias(c) for c in shown[:3]], F.greatest(a["confidence"], f["confidence"]).alias("confidence"))

        best = F.aggregate(own, F.struct(*[first[c].alias(c) for c in shown]), step)
        evidence = F.slice(F.flatten(F.transform(own, lambda f: f["evidence"])), 1, EVIDENCE_KEPT)
        return T.let(best, lambda b: F.struct((-b["severity"]).alias("order"), rule.alias("rule_id"), *[b[c].alias(c) for c in shown], evidence.alias("evidence")))

    def every(fs: Column) -> Column:
        rules = F.array_distinct(F.transform(fs, lambda f: f["rule_id"]))
        return F.array_sort(F.transform(rules, lambda r: merged(r, fs)))

    return F.transform(T.let(found, every), lambda x: F.struct(*[x[c].alias(c) for c in FIELDS]))


def is_prose(family: Column, rule: Column) -> Column:
    """Whether a finding charges the anti-AI score: a prose family, and no rule of the target voice."""
    return family.isin(*lexicon.PROSE_FAMILIES) & ~rule.isin(*_rules("voice"))


def anti_ai_score(merged: Column) -> Column:
    """1 less the weights of the collapsed prose findings over the budget; 1 where nothing fired."""
    weight = F.aggregate(merged, F.lit(0.0), lambda a, f: a + F.when(is_prose(f["family"], f["rule_id"]), f["severity"] / 5 * f["confidence"]).otherwise(0.0))
    return clamp_score(1 - weight / BUDGET)


def contributions(merged: Column) -> Column:
    """array<struct<value, label, weight, evidence>>: what each collapsed prose finding takes from the score, the largest first, at most 50."""
    prose = F.filter(merged, lambda f: is_prose(f["family"], f["rule_id"]))
    each = F.transform(prose, lambda f, i: F.struct(F.round(-f["severity"] / 5 * f["confidence"], 4).alias("value"), i.alias("i"), f["rule_id"].alias("label"), f["severity"].alias("weight"), F.substring(F.get(f["evidence"], 0)["text"], 1, 80).alias("evidence")))
    return F.transform(F.slice(F.array_sort(each), 1, CONTRIBUTIONS), lambda x: F.struct((-x["value"]).alias("value"), x["label"].alias("label"), x["weight"].alias("weight"), x["evidence"].alias("evidence")))


def scanned(rows: DataFrame, predates: bool = False) -> DataFrame:
    """Rows of ``detectors.with_findings`` with ``judged`` findings, ``merged`` ones and the ``anti_ai_score``, each computed once."""
    rows = rows.withColumn("judged", judged(F.col("found"), F.col("text"), predates))
    rows = rows.withColumn("merged", collapsed(kept(F.col("judged"))))
    return rows.withColumn("anti_ai_score", anti_ai_score(F.col("merged")))


def resolved(findings: DataFrame, rules: DataFrame, aliases: DataFrame, claims: DataFrame) -> DataFrame:
    """Findings (rule_id, upstream) with ``canonical_id``: the rule of that id, else the rule it is an alias of, else the rule that the upstream's own id belongs to; null if none.

    ``rules`` (rule_id), ``aliases`` (alias, rule_id) and ``claims`` (upstream, upstream_rule_id, rule_id) have one row per key; an id that
    an upstream gives to several rules belongs to the smallest.
    """
    direct = rules.select("rule_id", F.col("rule_id").alias("direct_id")).distinct()
    alias = aliases.groupBy(F.col("alias").alias("rule_id")).agg(F.min("rule_id").alias("alias_id"))
    own = claims.groupBy("upstream", F.col("upstream_rule_id").alias("rule_id")).agg(F.min(claims["rule_id"]).alias("own_id"))
    both = findings.join(direct, "rule_id", "left").join(alias, "rule_id", "left").join(own, ["upstream", "rule_id"], "left")
    return both.withColumn("canonical_id", F.coalesce("direct_id", "alias_id", "own_id")).drop("direct_id", "alias_id", "own_id")


def composed(anti_ai: Column, voice: Column, behavior: Column, preservation: Column) -> Column:
    """struct of the four scores and of the names of those that weren't measured."""
    named = {"anti_ai_score": anti_ai, "voice_score": voice, "behavior_score": behavior, "preservation_score": preservation}
    unmeasured = F.array_compact(F.array(*[F.when(c.isNull(), F.lit(n)) for n, c in named.items()]))
    return F.struct(*[c.alias(n) for n, c in named.items()], unmeasured.alias("unmeasured"))


def retry_recommended(preservation: Column, anti_ai: Column, behavior: Column, voice_regressed: Column) -> Column:
    """Whether a rewrite should be tried again; what wasn't measured doesn't ask for it."""
    below = lambda c, least: F.coalesce(c < least, F.lit(False))
    return below(preservation, 0.9) | below(anti_ai, 0.7) | below(behavior, 0.75) | F.coalesce(voice_regressed, F.lit(False))


def assert_not_blended(df: DataFrame) -> DataFrame:
    """The table itself, unless a column would hold a blend of the scores."""
    if found := FORBIDDEN & {c.lower() for c in df.columns}:
        raise ValueError(f"scores must not be blended: {sorted(found)}")
    return df


def counts_by(findings: DataFrame, key: str) -> DataFrame:
    """Findings by family, rule or detector."""
    return findings.groupBy(key).agg(F.count("*").alias("n"))
