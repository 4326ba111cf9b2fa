"""Evaluation statistics over scored samples.

Results are rows (sample, config, category, four nullable scores). What wasn't measured is null: it
is counted and takes part in no mean. Rank separation comes from ranks, never from pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FLAGGED, ASSISTANT_SHAPED = 0.7, 0.75
# Length buckets by characters.
LENGTHS = [("xs", 200), ("short", 600), ("medium", 1500)]
SCORES = ["anti_ai_score", "voice_score", "behavior_score", "preservation_score"]


def long_scores(results: DataFrame, *keys: str) -> DataFrame:
    """(keys, score, value): one row per result and score."""
    each = F.array(*[F.struct(F.lit(s).alias("score"), F.col(s).alias("value")) for s in SCORES])
    return results.select(*keys, F.inline(each))


def exact_sum(x: Column) -> Column:
    """Sum as a decimal of 18 places, which doesn't depend on the order of the rows."""
    return F.sum(x.cast("decimal(28,18)")).cast("double")


def summary_cells(results: DataFrame, *by: str) -> DataFrame:
    """(by, score, n, unmeasured, mean, median, spread, least, most) of every cell; mean and spread from sums that don't depend on the order of the rows."""
    x, n = F.col("value"), F.count("value")
    mean = F.try_divide(exact_sum(x), n)
    spread = F.sqrt(F.greatest(F.lit(0.0), F.try_divide(exact_sum(x * x), n) - mean * mean))
    some = lambda c: F.when(n > 0, c)
    return long_scores(results, *by).groupBy(*by, "score").agg(n.alias("n"), F.count_if(x.isNull()).alias("unmeasured"), mean.alias("mean"), F.percentile("value", F.lit(0.5)).alias("median"), some(spread).alias("spread"), F.min("value").alias("least"), F.max("value").alias("most"))


def flags(results: DataFrame, *by: str) -> DataFrame:
    """(by, n, flagged, assistant_shaped): results below the thresholds."""
    return results.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("anti_ai_score") < FLAGGED).alias("flagged"), F.count_if(F.col("behavior_score") < ASSISTANT_SHAPED).alias("assistant_shaped"))


def separation(values: DataFrame, value: str, subject: str, by: Sequence[str] = (), buckets: int = 1024) -> DataFrame:
    """(by, n_subject, n_control, separation): the share of pairs in which a subject exceeds a control, ties half; null if one side is empty.

    ``subject`` is a boolean column. Equal values are counted together; ranks are running sums within
    buckets of values between 0 and 1 and over the buckets' totals, so no task orders all values.
    """
    keys = list(by)
    counts = values.where(F.col(value).isNotNull() & F.col(subject).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count_if(subject).alias("a"), F.count_if(~F.col(subject)).alias("b"))
    # a monotonic bucket: what lies outside the range of scores shares the outermost ones
    counts = counts.withColumn("_k", F.floor(F.greatest(F.lit(-0.001), F.least(F.lit(1.001), F.col("_v"))) * buckets))
    totals = counts.groupBy(*keys, "_k").agg(F.sum("b").alias("_n"))
    before = lambda part, order: Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "_k", F.coalesce(F.sum("_n").over(before(keys or [F.lit(0)], "_k")), F.lit(0)).alias("_base"))
    below = F.coalesce(F.sum("b").over(before([*keys, "_k"], "_v")), F.lit(0))
    ranked = counts.withColumn("_below", below).join(totals, [*keys, "_k"]).withColumn("won", F.col("a") * (F.col("_base") + F.col("_below") + F.col("b") / 2))
    sums = ranked.groupBy(*keys).agg(F.sum("a").alias("n_subject"), F.sum("b").alias("n_control"), F.sum("won").alias("won"))
    return sums.select(*keys, "n_subject", "n_control", F.try_divide("won", F.col("n_subject") * F.col("n_control")).alias("separation"))


def config_deltas(cells: DataFrame, pairs: DataFrame, by: Sequence[str] = ("category",)) -> DataFrame:
    """(from_config, to_config, by, score, before, after, outcome): what each step between configurations does to a mean."""
    a = cells.select(F.col("config_id").alias("from_config"), *by, "score", F.col("mean").alias("before"))
    b = cells.select(F.col("config_id").alias("to_config"), *by, "score", F.col("mean").alias("after"))
    both = F.broadcast(pairs).join(a, "from_config").join(b, ["to_config", *by, "score"])
    outcome = F.when(F.col("before").isNull() & F.col("after").isNull(), "unmeasured").when(F.col("before").isNull(), "introduced").when(F.col("after").isNull(), "withdrawn").otherwise("delta")
    return both.withColumn("delta", F.col("after") - F.col("before")).withColumn("outcome", outcome)


def rule_tally(findings: DataFrame, rule: str, sample: str, category: str) -> DataFrame:
    """(rule, samples, categories): in how many distinct samples and which categories each rule fired."""
    return findings.select(rule, sample, category).distinct().groupBy(rule).agg(F.count_distinct(sample).alias("samples"), F.sort_array(F.collect_set(category)).alias("categories"))


def compare_runs(before: DataFrame, after: DataFrame, keys: Sequence[str], scores: Sequence[str] = tuple(SCORES)) -> DataFrame:
    """(keys, presence, <score>_delta): samples of either run; a delta is null unless both measured it."""
    a = before.select(*keys, *[F.col(s).alias(f"a_{s}") for s in scores], F.lit(True).alias("in_a"))
    b = after.select(*keys, *[F.col(s).alias(f"b_{s}") for s in scores], F.lit(True).alias("in_b"))
    presence = F.when(F.col("in_b").isNull(), "only before").when(F.col("in_a").isNull(), "only after").otherwise("both")
    return a.join(b, list(keys), "full").select(*keys, presence.alias("presence"), *[(F.col(f"b_{s}") - F.col(f"a_{s}")).alias(f"{s}_delta") for s in scores])


def rule_changes(before: Column, after: Column) -> Column:
    """struct<gained, lost> of two arrays of rules."""
    return F.struct(F.array_sort(F.array_except(after, before)).alias("gained"), F.array_sort(F.array_except(before, after)).alias("lost"))


def length_bucket(size: Column) -> Column:
    out = F.when(size.isNull(), None)
    for name, limit in LENGTHS:
        out = out.when(size < limit, name)
    return out.otherwise("long")


def strata_cell(*parts: Column) -> Column:
    """Parts joined by bars; null parts are 'unknown'."""
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("unknown")) for p in parts])


def census(rows: DataFrame, cell: str) -> DataFrame:
    return rows.groupBy(cell).agg(F.count("*").alias("n"))


def stratified_draw(rows: DataFrame, cell: str, position: str, limit: int) -> DataFrame:
    """``limit`` rows taken from the cells in turn, by position within a cell; all rows in order if the limit exceeds them.

    Ranks beyond ``limit`` cannot be drawn, so each cell is cut to its first rows before the cells meet.
    """
    w = Window.partitionBy(cell).orderBy(position)
    first = rows.groupBy(cell).agg(F.min(position).alias("_first"))
    ranked = rows.withColumn("_turn", F.row_number().over(w)).where(F.col("_turn") <= limit).join(first, cell)
    drawn = ranked.orderBy("_turn", "_first").limit(limit)
    return drawn.drop("_turn", "_first")


def poststratified_rate(rows: DataFrame, cell: str, hit: str, natural: DataFrame) -> DataFrame:
    """(raw_rate, weighted_rate): rate of ``hit``, and the cells' rates weighted by their natural shares (cell, n)."""
    rates = rows.groupBy(cell).agg(F.avg(F.col(hit).cast("double")).alias("rate"), F.count("*").alias("m"), F.sum(F.col(hit).cast("int")).alias("hits"))
    both = rates.join(natural.select(cell, "n"), cell)
    return both.agg((F.sum("hits") / F.sum("m")).alias("raw_rate"), (F.sum(F.col("rate") * F.col("n")) / F.sum("n")).alias("weighted_rate"))


def enrichment(rows: DataFrame, hit: str, triggered: str, *by: str) -> DataFrame:
    """(by, trigger_rate, control_rate, enrichment): a rule's rate where its trigger is present over its rate elsewhere."""
    rate = lambda cond: F.avg(F.when(cond, F.col(hit).cast("double")))
    out = rows.groupBy(*by).agg(rate(F.col(triggered)).alias("trigger_rate"), rate(~F.col(triggered)).alias("control_rate"))
    return out.withColumn("enrichment", F.try_divide("trigger_rate", "control_rate"))


def cofiring(rows: DataFrame, rules: Sequence[str]) -> DataFrame:
    """(rule_a, rule_b, together, expected): how often two boolean rules fire in one row, against independence."""
    n = F.count("*")
    pairs = [(a, b) for i, a in enumerate(rules) for b in rules[i + 1 :]]
    one = {r: F.count_if(F.col(r)) for r in rules}
    structs = [F.struct(F.lit(a).alias("rule_a"), F.lit(b).alias("rule_b"), F.count_if(F.col(a) & F.col(b)).alias("together"), F.try_divide(one[a] * one[b], n).cast("double").alias("expected")) for a, b in pairs]
    return rows.agg(F.array(*structs).alias("x")).select(F.inline("x"))


# Openings by which a reply declines or packages its task instead of answering.
REFUSAL = r"^\s*(?:(?:很?抱歉|对不起|不好意思)[，,]?\s*我(?:无法|不能|不可以|没办法)|作为一[个名]\s*(?:AI|人工智能)|我(?:无法|不能)(?:回答|提供|参与|继续|协助)|以下是(?:整理|修改|改写|优化|润色)|希望(?:这些|以上|这)对你有(?:所)?帮助)"
LEAST_REPLY, MOST_REPLY = 2, 400


def is_refusal(reply: Column) -> Column:
    """Whether a reply declines its task or wraps it up; a chat apology doesn't."""
    return F.coalesce(reply.rlike(REFUSAL), F.lit(False))


def rule_class(fired_a: Column, fired_b: Column, least: int = 4) -> Column:
    """'A' where only machine text fires, 'B' where both do, 'C' where human text fires more; null below the floor of firings."""
    return F.when(fired_a + fired_b < least, None).when(fired_a == 0, "A").when(fired_b > fired_a, "B").otherwise("C")


def hypothesis(found: DataFrame, least: float = 0.6, most: float = 0.4) -> DataFrame:
    """Separations with ``verdict``: 'untested' without one, 'supported' from ``least`` on, 'reversed' up to ``most``, else 'not separated'."""
    s = F.col("separation")
    return found.withColumn("verdict", F.when(s.isNull(), "untested").when(s >= least, "supported").when(s <= most, "reversed").otherwise("not separated"))


def flagged_human_rules(findings: DataFrame, samples: DataFrame, sample: str, rule: str = "rule_id") -> DataFrame:
    """(rule, samples, share): how many human-written samples each rule fires in, and of all human-written ones; rules that fire in none have no row.

    ``samples`` has (sample, provenance), one row per sample; it is cut to the human-written ones before the findings meet it.
    """
    human = samples.where("provenance = 'human-written'").select(sample)
    hits = findings.select(sample, rule).distinct().join(human, sample).groupBy(rule).agg(F.count("*").alias("samples"))
    return hits.crossJoin(F.broadcast(human.agg(F.count("*").alias("_n")))).select(rule, "samples", F.try_divide("samples", "_n").alias("share"))


def abstentions(outcomes: DataFrame, states: DataFrame) -> DataFrame:
    """(rule_id, state, source, n): replies in which a rule abstained, by what stopped it and whether that was stated.

    ``states`` has (reply_id, state, source): the permission that held and whether it was 'explicit' or the 'default'.
    """
    held = outcomes.where("outcome = 'abstained'").select("reply_id", "rule_id").join(states, "reply_id")
    return held.groupBy("rule_id", "state", "source").agg(F.count("*").alias("n"))
