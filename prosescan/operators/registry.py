"""Rule candidates to a registry: deduplication by signature, phrase ownership, provenance, version moves.

Groups may be large, so every list is built from values that were made distinct first.

Defined results: null severities don't vote, a rule without any gets 3; severities are clamped to
1..5; a null upstream counts as one upstream; ties go to the smallest id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosescan.functions.numbers import clamp_severity


def severity_by(policy: str, severity: Column) -> Column:
    """Aggregate of severities: 'max', 'median' or 'mean', rounded half up and clamped; 3 without any."""
    value = {"max": F.max(severity), "median": F.percentile(severity, F.lit(0.5)), "mean": F.avg(severity)}[policy]
    return F.when(value.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(5), F.floor(value + 0.5).cast("int")))).otherwise(3)


def canonical_rules(candidates: DataFrame, specs: DataFrame, policy: str = "max", aliases: dict[str, str] | None = None) -> DataFrame:
    """One rule per signature of candidates (rule_id, upstream, upstream_rule_id, signature, category, severity, weak_alone, description, detection, rewrite_guidance).

    A rule is weak alone if its vocabulary entry says so or at least half of its upstreams do, an
    upstream saying so if one of its candidates does. Texts are the first non-null by rule_id.
    """
    alias = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]) if aliases else None
    named = candidates.withColumn("signature", F.coalesce(alias[F.col("signature")], F.col("signature")) if aliases else F.col("signature"))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("rule_id"))).alias(c)
    merged = named.groupBy("signature").agg(
        F.count("*").alias("n_candidates"), F.count_distinct("category").alias("n_categories"), F.min_by("category", "rule_id").alias("category"),
        severity_by(policy, F.col("severity")).alias("severity"), first("description"), first("detection"), first("rewrite_guidance"),
    )
    votes = named.groupBy("signature", "upstream").agg(F.max(F.coalesce("weak_alone", F.lit(False))).alias("weak")).groupBy("signature").agg(F.count("*").alias("n_upstreams"), F.count_if("weak").alias("weak_votes"))
    spec = F.broadcast(specs.select("signature", F.col("weak_alone").alias("spec_weak"))) if specs is not None else None
    out = merged.join(votes, "signature")
    out = out.join(spec, "signature", "left") if spec is not None else out.withColumn("spec_weak", F.lit(None).cast("boolean"))
    weak = F.coalesce("spec_weak", F.lit(False)) | (F.col("weak_votes") * 2 >= F.col("n_upstreams"))
    return out.select("signature", "category", "severity", weak.alias("weak_alone"), "n_candidates", "n_upstreams", "weak_votes", (F.col("n_categories") > 1).alias("category_conflict"), (F.col("n_upstreams") > 1).alias("cross_upstream"), "description", "detection", "rewrite_guidance")


def phrase_owners(phrases: DataFrame, rules: DataFrame, key: Column, overrides: dict[str, str] | None = None) -> DataFrame:
    """(phrase_key, owner, n_claimants, decided_by) of every phrase (rule, phrase) key.

    ``phrases`` has ``rule``, ``rules`` has ``rule`` and ``severity``. The owner is the overriding
    rule, else the one with the fewest phrases, the greatest severity, the smallest id.
    """
    claims = phrases.select("rule", key.alias("phrase_key")).where("phrase_key <> ''").distinct()
    sizes = claims.groupBy("rule").agg(F.count("*").alias("n_phrases"))
    ranked = claims.join(sizes, "rule").join(rules.select("rule", "severity"), "rule")
    over = F.create_map(*[F.lit(x) for kv in overrides.items() for x in kv])[F.col("phrase_key")] if overrides else F.lit(None).cast("string")
    forced = F.coalesce(over == F.col("rule").cast("string"), F.lit(False))
    # one aggregation: the least struct is the best claimant, so no group of claimants is ever held as a whole
    best = F.min(F.struct(F.when(forced, 0).otherwise(1).alias("o"), F.col("n_phrases"), (-F.col("severity")).alias("s"), F.col("rule")))
    owned = ranked.groupBy("phrase_key").agg(best.alias("best"), F.count("*").alias("n_claimants"), F.count_distinct("n_phrases").alias("k"), F.min("n_phrases").alias("least"), F.min(F.when(F.col("n_phrases").isNotNull(), F.struct("n_phrases", -F.col("severity")))).alias("top"))
    decided = F.when(F.col("n_claimants") == 1, "only claimant").when(F.col("best.o") == 0, "override").when(F.col("k") > 1, "fewest phrases").otherwise("severity or id")
    return owned.select("phrase_key", F.col("best.rule").alias("owner"), "n_claimants", decided.alias("decided_by"))


def provenance(candidates: DataFrame) -> DataFrame:
    """(upstream, total, exclusive, shared): signatures that each upstream gives, alone or with others."""
    pairs = candidates.select("signature", "upstream").distinct()
    shared = pairs.groupBy("signature").agg(F.count("*").alias("n"))
    return pairs.join(shared, "signature").groupBy("upstream").agg(F.count("*").alias("total"), F.count_if(F.col("n") == 1).alias("exclusive"), F.count_if(F.col("n") > 1).alias("shared"))


def registry_statistics(rules: DataFrame) -> DataFrame:
    """(category, n_rules, n_weak, n_cross, mean_severity) of a registry."""
    return rules.groupBy("category").agg(F.count("*").alias("n_rules"), F.count_if("weak_alone").alias("n_weak"), F.count_if("cross_upstream").alias("n_cross"), F.avg("severity").alias("mean_severity"))


def renumbered(old: DataFrame, new: DataFrame, key: str = "signature", number: str = "number") -> DataFrame:
    """(key, old_number, new_number, outcome): carried, dropped or added from one numbering to the next; the first number of a key counts."""
    a = old.groupBy(key).agg(F.min(number).alias("old_number"))
    b = new.groupBy(key).agg(F.min(number).alias("new_number"))
    outcome = F.when(F.col("new_number").isNull(), "dropped").when(F.col("old_number").isNull(), "added").otherwise("carried")
    return a.join(b, key, "full").withColumn("outcome", outcome)


def heading_deltas(old: DataFrame, new: DataFrame, group: str = "upstream", number: str = "number", title: str = "title") -> DataFrame:
    """(group, number, state): added, removed, renamed or unchanged headings between two versions."""
    a = old.select(group, number, F.col(title).alias("old_title"), F.lit(True).alias("was"))
    b = new.select(group, number, F.col(title).alias("new_title"), F.lit(True).alias("now"))
    state = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("old_title").eqNullSafe(F.col("new_title")), "unchanged").otherwise("renamed")
    return a.join(b, [group, number], "full").select(group, number, "old_title", "new_title", state.alias("state"))


def unresolved(rows: DataFrame, column: str, known: DataFrame, key: str) -> DataFrame:
    """Rows whose value isn't in a vocabulary; null values are unresolved too."""
    return rows.join(known.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def resolved_signature(signature: Column, aliases: dict[str, str], hops: int = 8) -> Column:
    """The end of a signature's alias chain, null where none is found within so many hops."""
    ends: dict[str, str | None] = {}
    for start in aliases:
        at, seen = start, 0
        while at in aliases and seen <= hops:
            at, seen = aliases[at], seen + 1
        ends[start] = None if at in aliases else at
    if not ends:
        return signature
    chain = F.create_map(*[x for k, v in ends.items() for x in (F.lit(k), F.lit(v).cast("string"))])
    return F.when(F.array_contains(F.map_keys(chain), signature), chain[signature]).otherwise(signature)


def first_rows(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each group."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def clean_candidates(candidates: DataFrame) -> DataFrame:
    """Candidates with severities clamped to 1..5 where they have one."""
    return candidates.withColumn("severity", F.when(F.col("severity").isNotNull(), clamp_severity(F.col("severity"))))
