"""The toolkit's entry points over DataFrames: scan, prepare a rewrite, validate one; a scan is one pass over the texts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosescan.operators import behavior, contract, detectors, protected, scoring, voice
from prosescan.plans import lexicon


def scanned(docs: DataFrame, families: Iterable[str] | None = None, profile: DataFrame | None = None, by: list[str] | None = None, predates: bool = False) -> DataFrame:
    """Prepared texts with ``found``, ``judged`` and ``merged`` findings, scores and, with a voice profile, ``dimensions``.

    Texts that have a column user_turn have the assistant behaviours among their findings. ``profile`` has one row per value of
    the columns ``by``; texts without one are compared with nothing.
    """
    none = F.lit(None).cast("string")
    chosen = None if families is None else set(families)
    has = lambda c: F.col(c) if c in docs.columns else none
    more = F.array().cast(f"array<struct<{detectors._typed(detectors.FINDING)}>>")
    if chosen is None or "assistant" in chosen:
        docs = behavior.with_outcomes(docs, F.col("text"), has("user_turn"), has("advice_permission"))
        docs = docs.withColumn("behavior", behavior.row_score(F.col("outcomes")))
        if "user_turn" in docs.columns:
            more = F.concat(more, behavior.smell_findings(F.col("outcomes")))
    if profile is not None and (chosen is None or "stylometry" in chosen):
        docs = voice.with_dimensions(voice.with_features(docs), profile, by or [])
        more = F.concat(more, voice.voice_findings())
    rows = detectors.with_findings(docs.withColumn("more", more), families)
    return scoring.scanned(rows, predates)


def scan(texts: DataFrame, doc_id: str = "doc_id", text: str = "text", user_turn: str | None = None, permission: str | None = None, profile: DataFrame | None = None, by: list[str] | None = None, families: Iterable[str] | None = None) -> DataFrame:
    """(doc_id, n_findings, rules, scores) of every text; scores is a struct of four, null where unmeasured, and the names of those."""
    named = {new: F.col(old) for new, old in (("user_turn", user_turn), ("advice_permission", permission)) if old}
    rows = texts.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *[c.alias(n) for n, c in named.items()], *[F.col(c) for c in by or []])
    docs = scanned(detectors.prepared(rows, "doc_id", "text", *named, *(by or [])), families, profile, by)
    chosen = None if families is None else set(families)
    null = F.lit(None).cast("double")
    prose = F.when(F.lit(chosen is None or bool(chosen & set(lexicon.PROSE_FAMILIES))), F.col("anti_ai_score"))
    scores = scoring.composed(prose, voice.row_score(F.col("dimensions")) if "dimensions" in docs.columns else null, F.col("behavior.behavior_score") if "behavior" in docs.columns else null, null)
    return docs.select("doc_id", F.size("merged").alias("n_findings"), F.array_sort(F.transform("merged", lambda f: f["rule_id"])).alias("rules"), scores.alias("scores"))


def prepare(texts: DataFrame, doc_id: str = "doc_id", text: str = "text", mode: str | None = None, **told) -> DataFrame:
    """(doc_id, strategy, n_rules, n_protected, contract) for every text to be rewritten; ``told`` is what ``contract.contracts`` takes besides."""
    rows = texts.withColumn("declared", F.col(mode) if mode else F.lit(None).cast("string"))
    rows = contract.with_route(scanned(detectors.prepared(rows, doc_id, text, "declared")), F.col("text"), F.col("declared"))
    rows = rows.withColumn("masked", protected.masked(F.col("text")))
    return contract.contracts(rows.withColumn("items", protected.items(F.col("text"), F.col("masked"))), **told)


def validate(pairs: DataFrame, pair_id: str = "pair_id", original: str = "original", rewritten: str = "rewritten", user_turn: str | None = None, profile: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """(pair_id, scores, before, after, regressed, issues, summary, retry) of every rewrite against its original.

    ``before`` and ``after`` hold the behaviour and the voice score of each side, ``regressed`` the names of what fell by more than
    the tolerance, ``issues`` what became of protected items that weren't kept.
    """
    by = by or []
    named = [F.col(user_turn).alias("user_turn")] if user_turn else [F.lit(None).cast("string").alias("user_turn")]
    rows = pairs.select(F.col(pair_id).alias("pair_id"), *named, *by, F.coalesce(F.col(original), F.lit("")).alias("original"), F.coalesce(F.col(rewritten), F.lit("")).alias("rewritten"))
    sides = rows.select("pair_id", "user_turn", *by, F.inline(F.array(*[F.struct(F.lit(s).alias("side"), F.col(c).alias("text")) for s, c in (("before", "original"), ("after", "rewritten"))])))
    docs = detectors.prepared(sides.withColumn("doc_id", F.struct("pair_id", "side")), "doc_id", "text", "user_turn", *by)
    seen = scanned(docs, None, profile, by)
    manner = F.struct("anti_ai_score", F.col("behavior.behavior_score").alias("behavior_score"), (voice.row_score(F.col("dimensions")) if profile is not None else F.lit(None).cast("double")).alias("voice_score"))
    seen = seen.select("doc_id.pair_id", "doc_id.side", manner.alias("s")).groupBy("pair_id").agg(*[F.max(F.when(F.col("side") == x, F.col("s"))).alias(x) for x in ("before", "after")])
    states = protected.preservation(protected.protected_items(rows, "pair_id", "original"), rows, "pair_id", "rewritten")
    issue = F.when(F.col("state") != "kept", F.struct(F.col("severity"), F.col("state"), F.col("kind"), F.col("value")))
    kept = states.groupBy(F.col("doc_id").alias("pair_id")).agg(*protected.score_aggregates(), F.sort_array(F.collect_list(issue), asc=False).alias("issues"))
    whole = seen.join(kept, "pair_id", "left")
    fell = lambda c: F.when(behavior.regression(F.col(f"before.{c}"), F.col(f"after.{c}")), F.lit(c))
    regressed = F.array_compact(F.array(fell("behavior_score"), fell("voice_score")))
    scores = scoring.composed(F.col("after.anti_ai_score"), F.col("after.voice_score"), F.col("after.behavior_score"), F.col("preservation_score"))
    retry = scoring.retry_recommended(F.col("preservation_score"), F.col("after.anti_ai_score"), F.col("after.behavior_score"), F.array_contains(regressed, "voice_score"))
    issues = F.coalesce("issues", F.array().cast("array<struct<severity:int,state:string,kind:string,value:string>>"))
    summary = F.concat(F.coalesce(F.col("n_items"), F.lit(0)).cast("string"), F.lit(" protected item(s), "), F.size(issues).cast("string"), F.lit(" not kept; "), F.size(regressed).cast("string"), F.lit(" score(s) regressed"))
    return whole.select("pair_id", scores.alias("scores"), "before", "after", regressed.alias("regressed"), issues.alias("issues"), summary.alias("summary"), retry.alias("retry"))
