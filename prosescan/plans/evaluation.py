"""Queries over rules, phrases and scored samples, and over the relational tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prosescan.functions import text as T
from prosescan.operators import behavior, detectors, evaluate, registry, scoring
from prosescan.plans import analysis, api, lexicon
from prosescan.sources import corpus
from prosescan.sources.tables import spread, table


def _long(*names: str):
    return [F.col(n).cast("bigint").alias(n) for n in names]


def _round(*names: str, places: int = 6):
    return [F.round(F.col(n).cast("double"), places).alias(n) for n in names]


# ---- rules ----


def rule_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = registry.clean_candidates(table(spark, sf_dir, "extracted_rules"))
    rules = registry.canonical_rules(rows, table(spark, sf_dir, "signature_specs"))
    return rules.select("signature", "category", *_long("severity", "n_candidates", "n_upstreams", "weak_votes"), "weak_alone", "category_conflict", "cross_upstream", "description")


def rule_severity_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = registry.clean_candidates(table(spark, sf_dir, "extracted_rules"))
    return rows.groupBy("signature").agg(*[registry.severity_by(p, F.col("severity")).cast("bigint").alias(f"{p}_severity") for p in ("max", "median", "mean")])


def phrase_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owner of every watched phrase of any script, by the key of ``T.phrase_key``: among the signatures of the rules that watch it, the one with the fewest phrases."""
    rules = registry.clean_candidates(table(spark, sf_dir, "extracted_rules"))
    phrases = table(spark, sf_dir, "watch_phrases").join(rules.select("rule_id", F.col("signature").alias("rule")), "rule_id")
    severities = rules.groupBy(F.col("signature").alias("rule")).agg(F.coalesce(F.max("severity"), F.lit(3)).alias("severity"))
    return registry.phrase_owners(phrases, severities, T.phrase_key(F.col("text"))).select("phrase_key", "owner", *_long("n_claimants"))


def phrase_index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases by owner: how many it owns, how many of them others claim too, and findings spared by owning them once."""
    n = F.col("n_claimants")
    return phrase_ownership(spark, sf_dir).groupBy("owner").agg(F.count("*").alias("n_phrases"), F.count_if(n > 1).alias("n_contested"), F.sum(n - 1).alias("n_spared"))


def rule_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upstreams' rule numbers in all snapshots, resolved to canonical signatures by what the extracted rules say of them."""
    found = table(spark, sf_dir, "rule_snapshots").select("upstream", F.col("upstream_rule_id").alias("rule_id")).distinct()
    specs = table(spark, sf_dir, "signature_specs").select(F.col("signature").alias("rule_id"))
    claims = table(spark, sf_dir, "extracted_rules").select("upstream", "upstream_rule_id", F.col("signature").alias("rule_id"))
    none = spark.createDataFrame([], "alias string, rule_id string")
    return scoring.resolved(found, specs, none, claims.where("upstream_rule_id is not null")).groupBy("upstream").agg(F.count("*").alias("n"), F.count("canonical_id").alias("n_resolved"), F.count_distinct("canonical_id").alias("n_signatures"))


def rule_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.provenance(table(spark, sf_dir, "extracted_rules"))


def registry_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = registry.clean_candidates(table(spark, sf_dir, "extracted_rules"))
    stats = registry.registry_statistics(registry.canonical_rules(rows, table(spark, sf_dir, "signature_specs")))
    return stats.select("category", *_long("n_rules", "n_weak", "n_cross"), *_round("mean_severity"))


def unmapped_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    lost = registry.unresolved(table(spark, sf_dir, "extracted_rules"), "signature", table(spark, sf_dir, "signature_specs"), "signature")
    return lost.groupBy("signature").agg(F.count("*").alias("n"))


def _ends(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """First and last snapshot of each upstream, one row per rule: the one loaded last."""
    rows = table(spark, sf_dir, "rule_snapshots")
    spans = rows.groupBy("upstream").agg(F.min("extracted_at").alias("first_at"), F.max("extracted_at").alias("last_at"))
    rows = rows.join(spans, "upstream").where("extracted_at in (first_at, last_at)")
    last = F.max(F.struct("loaded_at", F.trim("title").alias("title"), "signature")).alias("v")
    latest = rows.groupBy("upstream", "extracted_at", "first_at", "last_at", F.col("upstream_rule_id").alias("number")).agg(last).select("upstream", "extracted_at", "first_at", "last_at", "number", "v.title", "v.signature")
    return latest.where("extracted_at = first_at"), latest.where("extracted_at = last_at")


def heading_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = registry.heading_deltas(*_ends(spark, sf_dir))
    return rows.groupBy("upstream", "state").agg(F.count("*").alias("n"))


def renumbered_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How signatures move between the rule numbers of the first and of the last snapshots."""
    rows = registry.renumbered(*_ends(spark, sf_dir))
    return rows.select("signature", "old_number", "new_number", "outcome")


def manifest_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.manifest_problems(table(spark, sf_dir, "manifest"))


def upstreams_without_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "manifest").where("tracked").select(F.col("name").alias("upstream")).distinct()
    return names.join(table(spark, sf_dir, "extracted_rules").select("upstream").distinct(), "upstream", "left_anti")


def corpus_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.corpus_counts(table(spark, sf_dir, "documents"))


def corpus_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.corpus_hash(table(spark, sf_dir, "documents"), "doc_id", ["category", "lang", "mode", "provenance", "text"])


# ---- scored samples ----


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per result: identical deliveries once, joined with their document's category."""
    rows = table(spark, sf_dir, "sample_results")
    rows = rows.withColumn("_u", F.array_join("unmeasured", ",")).drop("unmeasured").distinct()
    docs = table(spark, sf_dir, "documents").select("doc_id", "category", "provenance", F.char_length("text").alias("size"))
    return rows.join(docs, "doc_id")


def score_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluate.summary_cells(_results(spark, sf_dir), "config_id", "category")
    return rows.select("config_id", "category", "score", *_long("n", "unmeasured"), *_round("mean", "median", "spread", "least", "most"))


def score_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.flags(_results(spark, sf_dir), "config_id", "category")


def score_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluate.long_scores(_results(spark, sf_dir).withColumn("human", F.col("provenance") == "human-written"), "config_id", "human")
    found = evaluate.separation(rows.withColumn("subject", ~F.col("human")), "value", "subject", ["config_id", "score"])
    return found.select("config_id", "score", *_long("n_subject", "n_control"), *_round("separation"))


def hypothesis_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each score tells machine-written samples from human-written ones."""
    return evaluate.hypothesis(score_separation(spark, sf_dir)).select("config_id", "score", "separation", "verdict")


def human_false_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that fire in human-written documents, and in what share of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "provenance", "user_turn", "advice_permission")
    found = api.scanned(detectors.prepared(docs.where("provenance = 'human-written'"), "doc_id", "text", "provenance")).select("doc_id", F.inline(T.each("merged")))
    return evaluate.flagged_human_rules(found, docs, "doc_id").select("rule_id", "samples", *_round("share"))


def abstention_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies in which a behaviour abstained, by the state that stopped it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "user_turn", "advice_permission")
    stated = F.col("advice_permission").isin("granted", "absent", "unknown")
    states = docs.select(F.col("doc_id").alias("reply_id"), F.when(stated, F.col("advice_permission")).otherwise("unknown").alias("state"), F.when(stated, "explicit").otherwise("default").alias("source"))
    return evaluate.abstentions(behavior.outcomes(spread(docs), "doc_id", "text"), states)


def configured_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document under every configuration: number of rules and scores, null where its families don't measure them; one scan serves all."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "user_turn", "advice_permission")
    rows = api.scanned(detectors.prepared(docs, "doc_id", "text", "user_turn", "advice_permission")).select("doc_id", "text", "found", "behavior")
    each = []
    for name, families in lexicon.configs().items():
        own = F.filter("found", lambda f: f["family"].isin(*families)) if families else F.slice("found", 1, 0)
        merged = scoring.collapsed(scoring.kept(scoring.judged(own, F.col("text"))))
        prose = bool(set(families) & set(lexicon.PROSE_FAMILIES))
        each.append(T.let(merged, _configured(name, prose, "assistant" in families)))
    return rows.select("doc_id", F.inline(F.array(*each)))


def _configured(name: str, prose: bool, assistant: bool):
    null = F.lit(None).cast("double")
    return lambda m: F.struct(F.lit(name).alias("config_id"), F.size(m).cast("bigint").alias("n_rules"), (F.round(scoring.anti_ai_score(m), 6) if prose else null).alias("anti_ai_score"), (F.round("behavior.behavior_score", 6) if assistant else null).alias("behavior_score"))


STEPS = [("baseline", "anti-only"), ("baseline", "voice-only"), ("baseline", "behaviour-only"), ("anti-only", "anti-voice"), ("anti-voice", "everything"), ("no-suppression", "everything")]


def config_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = evaluate.summary_cells(_results(spark, sf_dir), "config_id", "category")
    rows = evaluate.config_deltas(cells, spark.createDataFrame(STEPS, "from_config string, to_config string"))
    return rows.select("from_config", "to_config", "category", "score", *_round("before", "after", "delta", places=9), "outcome")


def unmeasured_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "sample_results").select("result_id", "config_id", F.explode("unmeasured").alias("score")).distinct()
    return rows.groupBy("config_id", "score").agg(F.count("*").alias("n"))


def run_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full configuration against the anti-AI one, as if they were two runs: mean deltas by presence."""
    rows = _results(spark, sf_dir).groupBy("doc_id", "config_id").agg(*[F.avg(s).alias(s) for s in evaluate.SCORES])
    both = evaluate.compare_runs(rows.where("config_id = 'anti-only'"), rows.where("config_id = 'everything'"), ["doc_id"])
    return both.groupBy("presence").agg(F.count("*").alias("n"), *[F.round(F.avg(f"{s}_delta"), 6).alias(f"{s}_delta") for s in evaluate.SCORES])


def rule_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures gained and lost by each upstream between its first and last snapshot."""
    old, new = (x.groupBy("upstream").agg(F.collect_set("signature").alias("s")) for x in _ends(spark, sf_dir))
    both = old.join(new.withColumnRenamed("s", "t"), "upstream").select("upstream", evaluate.rule_changes(F.col("s"), F.col("t")).alias("c"))
    return both.select("upstream", F.array_join("c.gained", ",").alias("gained"), F.array_join("c.lost", ",").alias("lost"))


def _strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    turn = F.when(F.col("user_turn").isNull(), "single").otherwise("multi")
    cell = evaluate.strata_cell(turn, evaluate.length_bucket(F.char_length("text")), F.col("mode"), F.col("advice_permission"))
    return docs.select("doc_id", "provenance", "text", cell.alias("cell"), evaluate.length_bucket(F.char_length("text")).alias("bucket"))


def strata_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.census(_strata(spark, sf_dir), "cell")


def stratified_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.stratified_draw(_strata(spark, sf_dir).select("doc_id", "cell"), "cell", "doc_id", 200)


def poststratified_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _strata(spark, sf_dir).withColumn("hit", F.coalesce(F.col("text").rlike("[?？]"), F.lit(False)))
    human = rows.where("provenance = 'human-written'")
    return evaluate.poststratified_rate(human, "cell", "hit", evaluate.census(rows, "cell")).select(*_round("raw_rate", "weighted_rate"))


def _marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _strata(spark, sf_dir).where("text is not null")
    return rows.select("doc_id", "provenance", "bucket", *[F.col("text").rlike(p).alias(n) for n, p in (("question", "[?？]"), ("exclamation", "[!！]"), ("quotation", "[“「\"]"), ("digit", "[0-9]"))], F.char_length("text").alias("size"), T.count(F.col("text"), "[!！]").alias("n_exclamation"))


def rule_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluate.enrichment(_marks(spark, sf_dir), "exclamation", "question", "bucket")
    return rows.select("bucket", *_round("trigger_rate", "control_rate", "enrichment"))


def rule_cofiring(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluate.cofiring(_marks(spark, sf_dir), ["question", "exclamation", "quotation", "digit"])
    return rows.select("rule_a", "rule_b", "together", *_round("expected"))


def rates_per_thousand(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _marks(spark, sf_dir).groupBy("provenance", "bucket").agg(F.count("*").alias("n"), F.sum("n_exclamation").alias("hits"), (F.sum("n_exclamation") * 1000 / F.sum("size")).alias("rate"))
    return rows.select("provenance", "bucket", *_long("n", "hits"), *_round("rate"))


def coverage_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.coalesce("mode", F.lit("unknown")).alias("mode"), F.coalesce("provenance", F.lit("unknown")).alias("provenance"))
    return rows.cube("mode", "provenance").agg(F.count("*").alias("n"))


# ---- relational tables: what the engine inherits from its platform ----


def revenue_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    revenue = F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).cast("double")
    return rows.rollup("r_name", "n_name").agg(revenue.alias("revenue"), F.count("*").alias("n"))


def top_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    sums = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").cast("double").alias("quantity"))
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("quantity"), "l_partkey")
    return sums.withColumn("place", F.row_number().over(w).cast("bigint")).where("place <= 3")


def events_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type")
    return rows.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", "total")


def customers_without_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n, c: table(spark, sf_dir, n).select(F.col(c).alias("custkey"))
    return t("customer", "c_custkey").exceptAll(t("orders", "o_custkey").distinct())


QUERIES = {
    f.__name__: f
    for f in (
        rule_dedupe, rule_severity_policies, phrase_ownership, phrase_index_stats, rule_resolution, rule_provenance, registry_statistics, unmapped_signatures, heading_deltas, renumbered_rules, manifest_problems, upstreams_without_rules,
        corpus_counts, corpus_hash, score_cells, score_flags, score_separation, hypothesis_verdicts, human_false_positives, abstention_tally, configured_scores, config_deltas, unmeasured_tally, run_comparison, rule_changes, strata_census, stratified_draw, poststratified_rate,
        rule_enrichment, rule_cofiring, rates_per_thousand, coverage_matrix, revenue_rollup, top_parts, events_by_hour, customers_without_orders,
    )
}

# ---- SQL ----

CANDIDATES = "cands AS (SELECT * REPLACE (CASE WHEN severity IS NOT NULL THEN greatest(1, least(5, severity)) END AS severity) FROM extracted_rules)"
VOTES = """
votes AS (SELECT signature, count(*) AS n_upstreams, count(*) FILTER (weak) AS weak_votes FROM (SELECT signature, upstream, max(coalesce(weak_alone, false)) AS weak FROM cands GROUP BY ALL) GROUP BY signature),
merged AS (SELECT signature, count(*) AS n_candidates, count(DISTINCT category) AS k, arg_min(category, rule_id) AS category, coalesce(max(severity), 3)::BIGINT AS severity, arg_min(description, rule_id) FILTER (description IS NOT NULL) AS description FROM cands GROUP BY signature),
canon AS (
  SELECT m.signature, m.category, m.severity, n_candidates, n_upstreams, weak_votes, coalesce(s.weak_alone, false) OR weak_votes * 2 >= n_upstreams AS weak_alone, k > 1 AS category_conflict, n_upstreams > 1 AS cross_upstream, m.description
  FROM merged m JOIN votes v USING (signature) LEFT JOIN signature_specs s USING (signature)
)"""
ENDS = """
latest AS (
  SELECT upstream, extracted_at, upstream_rule_id AS number, trim(title, ' ') AS title, signature, min(extracted_at) OVER (PARTITION BY upstream) AS first_at, max(extracted_at) OVER (PARTITION BY upstream) AS last_at, loaded_at FROM rule_snapshots
),
one AS (SELECT * FROM latest WHERE extracted_at IN (first_at, last_at) QUALIFY row_number() OVER (PARTITION BY upstream, extracted_at, number ORDER BY loaded_at DESC, title DESC NULLS LAST, signature DESC) = 1),
olds AS (SELECT * FROM one WHERE extracted_at = first_at), news AS (SELECT * FROM one WHERE extracted_at = last_at)"""
RESULTS = "res AS (SELECT r.*, d.category, d.provenance FROM (SELECT DISTINCT * FROM sample_results) r JOIN documents d USING (doc_id))"
LONG = "longs AS (SELECT config_id, category, provenance, unnest(['anti_ai_score', 'voice_score', 'behavior_score', 'preservation_score']) AS score, unnest([anti_ai_score, voice_score, behavior_score, preservation_score]) AS value FROM res)"
BUCKET = "CASE WHEN text IS NULL THEN NULL WHEN length(text) < 200 THEN 'xs' WHEN length(text) < 600 THEN 'short' WHEN length(text) < 1500 THEN 'medium' ELSE 'long' END"
STRATA = f"strata AS (SELECT doc_id, provenance, text, {BUCKET} AS bucket, concat_ws('|', CASE WHEN user_turn IS NULL THEN 'single' ELSE 'multi' END, coalesce({BUCKET}, 'unknown'), coalesce(mode, 'unknown'), coalesce(advice_permission, 'unknown')) AS cell FROM documents)"
MARKED = STRATA + """, marks AS (SELECT doc_id, provenance, bucket, regexp_matches(text, '[?？]') AS question, regexp_matches(text, '[!！]') AS exclamation, regexp_matches(text, '[“「"]') AS quotation, regexp_matches(text, '[0-9]') AS digit, length(text) AS size, len(regexp_extract_all(text, '[!！]')) AS n_ex FROM strata WHERE text IS NOT NULL)"""
RULES4 = ["question", "exclamation", "quotation", "digit"]

SPACES = r"[\s\x0b\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
EDGE = r"""[ !?.,;:()\[\]"''“”。！？，、]+"""
OWNERSHIP = f"""
WITH {CANDIDATES},
claims AS (SELECT DISTINCT c.signature AS rule, regexp_replace(regexp_replace(lower(w.text), '{SPACES}', ' ', 'g'), '^{EDGE}|{EDGE}$', '', 'g') AS phrase_key FROM watch_phrases w JOIN cands c USING (rule_id) WHERE phrase_key <> ''),
sizes AS (SELECT rule, count(*) AS n FROM claims GROUP BY rule), sev AS (SELECT signature AS rule, coalesce(max(severity), 3) AS s FROM cands GROUP BY signature)
SELECT phrase_key, rule AS owner, count(*) OVER (PARTITION BY phrase_key) AS n_claimants FROM claims JOIN sizes USING (rule) JOIN sev USING (rule) QUALIFY row_number() OVER (PARTITION BY phrase_key ORDER BY n, s DESC, rule) = 1
"""

SEPARATION = f"""
WITH {RESULTS}, {LONG}, v AS (SELECT *, provenance <> 'human-written' AS subject FROM longs WHERE value IS NOT NULL AND provenance IS NOT NULL),
n AS (SELECT config_id, score, count(*) FILTER (subject) AS n_subject, count(*) FILTER (NOT subject) AS n_control FROM v GROUP BY ALL),
w AS (SELECT a.config_id, a.score, sum(CASE WHEN a.value > b.value THEN 1.0 WHEN a.value = b.value THEN 0.5 ELSE 0.0 END) AS won FROM v a JOIN v b ON a.config_id = b.config_id AND a.score = b.score WHERE a.subject AND NOT b.subject GROUP BY ALL)
SELECT config_id, score, n_subject, n_control, round((won / nullif(n_subject * n_control, 0))::DOUBLE, 6) AS separation FROM n LEFT JOIN w USING (config_id, score)
"""

SQL = {
    "rule_dedupe": f"WITH {CANDIDATES}, {VOTES} SELECT * FROM canon",
    "rule_severity_policies": f"WITH {CANDIDATES} SELECT signature, coalesce(max(severity), 3)::BIGINT AS max_severity, coalesce(floor(quantile_cont(severity, 0.5) + 0.5), 3)::BIGINT AS median_severity, coalesce(floor(avg(severity) + 0.5), 3)::BIGINT AS mean_severity FROM cands GROUP BY signature",
    "phrase_ownership": OWNERSHIP,
    "phrase_index_stats": f"WITH owned AS ({OWNERSHIP}) SELECT owner, count(*) AS n_phrases, count(*) FILTER (n_claimants > 1) AS n_contested, sum(n_claimants - 1)::BIGINT AS n_spared FROM owned GROUP BY owner",
    "rule_resolution": """
WITH found AS (SELECT DISTINCT upstream, upstream_rule_id AS rule_id FROM rule_snapshots), own AS (SELECT upstream, upstream_rule_id AS rule_id, min(signature) AS s FROM extracted_rules WHERE upstream_rule_id IS NOT NULL GROUP BY ALL)
SELECT f.upstream, count(*) AS n, count(coalesce(p.signature, o.s)) AS n_resolved, count(DISTINCT coalesce(p.signature, o.s)) AS n_signatures
FROM found f LEFT JOIN signature_specs p ON p.signature = f.rule_id LEFT JOIN own o ON o.upstream = f.upstream AND o.rule_id = f.rule_id GROUP BY f.upstream
""",
    "rule_provenance": "WITH p AS (SELECT DISTINCT signature, upstream FROM extracted_rules), k AS (SELECT signature, count(*) AS n FROM p GROUP BY signature) SELECT upstream, count(*) AS total, count(*) FILTER (n = 1) AS exclusive, count(*) FILTER (n > 1) AS shared FROM p JOIN k USING (signature) GROUP BY upstream",
    "registry_statistics": f"WITH {CANDIDATES}, {VOTES} SELECT category, count(*) AS n_rules, count(*) FILTER (weak_alone) AS n_weak, count(*) FILTER (cross_upstream) AS n_cross, round(avg(severity), 6) AS mean_severity FROM canon GROUP BY category",
    "unmapped_signatures": "SELECT signature, count(*) AS n FROM extracted_rules WHERE signature NOT IN (SELECT signature FROM signature_specs) GROUP BY signature",
    "heading_deltas": f"""
WITH {ENDS}, met AS (
  SELECT coalesce(o.upstream, n.upstream) AS upstream, CASE WHEN o.upstream IS NULL THEN 'added' WHEN n.upstream IS NULL THEN 'removed' WHEN o.title IS NOT DISTINCT FROM n.title THEN 'unchanged' ELSE 'renamed' END AS state
  FROM olds o FULL JOIN news n ON o.upstream = n.upstream AND o.number = n.number
) SELECT upstream, state, count(*) AS n FROM met GROUP BY ALL
""",
    "renumbered_rules": f"""
WITH {ENDS}, a AS (SELECT signature, min(number) AS old_number FROM olds GROUP BY signature), b AS (SELECT signature, min(number) AS new_number FROM news GROUP BY signature)
SELECT coalesce(a.signature, b.signature) AS signature, old_number, new_number, CASE WHEN new_number IS NULL THEN 'dropped' WHEN old_number IS NULL THEN 'added' ELSE 'carried' END AS outcome FROM a FULL JOIN b ON a.signature = b.signature
""",
    "manifest_problems": """
WITH m AS (SELECT DISTINCT * FROM manifest),
own AS (
  SELECT name, unnest([CASE WHEN coalesce(trim(name), '') = '' THEN 'missing name' END, CASE WHEN coalesce(trim(repository), '') = '' THEN 'missing repository' END, CASE WHEN coalesce(trim(license), '') = '' THEN 'missing license' END,
    CASE WHEN NOT regexp_matches(commit_sha, '^[0-9a-f]{40}$') THEN 'bad commit' END, CASE WHEN try_strptime(last_sync, '%Y-%m-%d') IS NULL AND last_sync IS NOT NULL THEN 'bad date' END, CASE WHEN coalesce(len(roles), 0) < 1 THEN 'no role' END]) AS problem FROM m
),
parents AS (SELECT DISTINCT name, lower(trim(x)) AS parent FROM (SELECT name, unnest(derived_from) AS x FROM m))
SELECT name, problem FROM own WHERE problem IS NOT NULL
UNION ALL SELECT name, 'unknown parent ' || parent FROM parents WHERE parent NOT IN (SELECT lower(trim(name)) FROM m)
""",
    "upstreams_without_rules": "SELECT DISTINCT name AS upstream FROM manifest WHERE tracked AND name NOT IN (SELECT upstream FROM extracted_rules WHERE upstream IS NOT NULL)",
    "corpus_counts": f"""
WITH known(category) AS (VALUES {", ".join(f"('{c}')" for c in corpus.DOMAINS["category"])}), c AS (SELECT k.category, count(d.doc_id) AS n FROM known k LEFT JOIN documents d ON d.category = k.category GROUP BY k.category)
SELECT category, n, CASE WHEN n = 0 THEN 'unpopulated' WHEN n < 20 THEN 'thin' ELSE 'populated' END AS state FROM c
""",
    "score_cells": f"""WITH {RESULTS}, {LONG} SELECT config_id, category, score, count(value) AS n, count(*) - count(value) AS unmeasured, round(sum(value::DECIMAL(28,18))::DOUBLE / count(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median,
  round(sqrt(greatest(0, sum((value * value)::DECIMAL(28,18))::DOUBLE / count(value) - (sum(value::DECIMAL(28,18))::DOUBLE / count(value)) * (sum(value::DECIMAL(28,18))::DOUBLE / count(value)))), 6) AS spread, round(min(value), 6) AS least, round(max(value), 6) AS most FROM longs GROUP BY ALL""",
    "corpus_hash": """
WITH h AS (SELECT sha256(array_to_string([doc_id::VARCHAR, coalesce(category, ''), coalesce(lang, ''), coalesce(mode, ''), coalesce(provenance, ''), coalesce(text, '')], chr(31))) AS h FROM documents),
b AS (SELECT h[1:3] AS bucket, count(*) AS n, """ + ", ".join(f"sum(('0x' || h[{1 + 16 * i}:{16 + 16 * i}])::UBIGINT::HUGEINT) AS s{i}" for i in range(4)) + """ FROM h GROUP BY 1)
SELECT sum(n)::BIGINT AS n, sha256(string_agg(line, chr(10) ORDER BY line)) AS hash FROM (SELECT n, concat_ws(':', bucket, n, s0, s1, s2, s3) AS line FROM b)
""",
    "score_flags": f"WITH {RESULTS} SELECT config_id, category, count(*) AS n, count(*) FILTER (anti_ai_score < 0.7) AS flagged, count(*) FILTER (behavior_score < 0.75) AS assistant_shaped FROM res GROUP BY ALL",
    "score_separation": SEPARATION,
    "hypothesis_verdicts": f"""
WITH sep AS ({SEPARATION})
SELECT config_id, score, separation, CASE WHEN separation IS NULL THEN 'untested' WHEN separation >= 0.6 THEN 'supported' WHEN separation <= 0.4 THEN 'reversed' ELSE 'not separated' END AS verdict FROM sep
""",
    "abstention_tally": f"""
WITH {analysis.SMELLS}
SELECT rule_id, CASE WHEN d.advice_permission IN ('granted', 'absent', 'unknown') THEN d.advice_permission ELSE 'unknown' END AS state,
  CASE WHEN d.advice_permission IN ('granted', 'absent', 'unknown') THEN 'explicit' ELSE 'default' END AS source, count(*) AS n
FROM outcomes o JOIN documents d USING (doc_id) WHERE outcome = 'abstained' GROUP BY ALL
""",
    "config_deltas": f"""
WITH {RESULTS}, {LONG}, cells AS (SELECT config_id, category, score, avg(value) AS mean FROM longs GROUP BY ALL),
steps(f, t) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in STEPS)})
SELECT f AS from_config, t AS to_config, a.category, a.score, round(a.mean, 9) AS before, round(b.mean, 9) AS after, round(b.mean - a.mean, 9) AS delta,
  CASE WHEN a.mean IS NULL AND b.mean IS NULL THEN 'unmeasured' WHEN a.mean IS NULL THEN 'introduced' WHEN b.mean IS NULL THEN 'withdrawn' ELSE 'delta' END AS outcome
FROM steps JOIN cells a ON a.config_id = f JOIN cells b ON b.config_id = t AND a.category IS NOT DISTINCT FROM b.category AND a.score = b.score WHERE a.category IS NOT NULL
""",
    "unmeasured_tally": "SELECT config_id, score, count(*) AS n FROM (SELECT DISTINCT result_id, config_id, unnest(unmeasured) AS score FROM sample_results) GROUP BY ALL",
    "run_comparison": f"""
WITH {RESULTS}, m AS (SELECT doc_id, config_id, avg(anti_ai_score) AS a, avg(voice_score) AS v, avg(behavior_score) AS b, avg(preservation_score) AS p FROM res GROUP BY ALL),
x AS (SELECT CASE WHEN n.doc_id IS NULL THEN 'only before' WHEN o.doc_id IS NULL THEN 'only after' ELSE 'both' END AS presence, n.a - o.a AS a, n.v - o.v AS v, n.b - o.b AS b, n.p - o.p AS p
  FROM (SELECT * FROM m WHERE config_id = 'anti-only') o FULL JOIN (SELECT * FROM m WHERE config_id = 'everything') n ON o.doc_id = n.doc_id)
SELECT presence, count(*) AS n, round(avg(a), 6) AS anti_ai_score_delta, round(avg(v), 6) AS voice_score_delta, round(avg(b), 6) AS behavior_score_delta, round(avg(p), 6) AS preservation_score_delta FROM x GROUP BY presence
""",
    "rule_changes": f"""
WITH {ENDS}, ups AS (SELECT DISTINCT o.upstream FROM olds o JOIN news n USING (upstream)),
g AS (SELECT upstream, string_agg(signature, ',' ORDER BY signature) AS s FROM (SELECT DISTINCT upstream, signature FROM news EXCEPT SELECT DISTINCT upstream, signature FROM olds) GROUP BY upstream),
l AS (SELECT upstream, string_agg(signature, ',' ORDER BY signature) AS s FROM (SELECT DISTINCT upstream, signature FROM olds EXCEPT SELECT DISTINCT upstream, signature FROM news) GROUP BY upstream)
SELECT upstream, coalesce(g.s, '') AS gained, coalesce(l.s, '') AS lost FROM ups LEFT JOIN g USING (upstream) LEFT JOIN l USING (upstream)
""",
    "strata_census": f"WITH {STRATA} SELECT cell, count(*) AS n FROM strata GROUP BY cell",
    "stratified_draw": f"WITH {STRATA} SELECT doc_id, cell FROM (SELECT doc_id, cell, row_number() OVER (PARTITION BY cell ORDER BY doc_id) AS turn, min(doc_id) OVER (PARTITION BY cell) AS f FROM strata) ORDER BY turn, f LIMIT 200",
    "poststratified_rate": f"""
WITH {STRATA}, h AS (SELECT cell, avg(coalesce(regexp_matches(text, '[?？]'), false)::INT) AS rate, count(*) AS m, sum(coalesce(regexp_matches(text, '[?？]'), false)::INT) AS hits FROM strata WHERE provenance = 'human-written' GROUP BY cell), c AS (SELECT cell, count(*) AS n FROM strata GROUP BY cell)
SELECT round((sum(hits) / sum(m))::DOUBLE, 6) AS raw_rate, round((sum(rate * n) / sum(n))::DOUBLE, 6) AS weighted_rate FROM h JOIN c USING (cell)
""",
    "rule_enrichment": f"WITH {MARKED}, r AS (SELECT bucket, avg(exclamation::INT) FILTER (question) AS trigger_rate, avg(exclamation::INT) FILTER (NOT question) AS control_rate FROM marks GROUP BY bucket) SELECT bucket, round(trigger_rate, 6) AS trigger_rate, round(control_rate, 6) AS control_rate, round(trigger_rate / nullif(control_rate, 0), 6) AS enrichment FROM r",
    "rule_cofiring": f"WITH {MARKED} " + " UNION ALL ".join(f"SELECT '{a}' AS rule_a, '{b}' AS rule_b, count(*) FILTER ({a} AND {b}) AS together, round((count(*) FILTER ({a}) * count(*) FILTER ({b}) / count(*))::DOUBLE, 6) AS expected FROM marks" for i, a in enumerate(RULES4) for b in RULES4[i + 1 :]),
    "rates_per_thousand": f"WITH {MARKED} SELECT provenance, bucket, count(*) AS n, sum(n_ex)::BIGINT AS hits, round((sum(n_ex) * 1000 / nullif(sum(size), 0))::DOUBLE, 6) AS rate FROM marks GROUP BY ALL",
    "coverage_matrix": "SELECT m AS mode, p AS provenance, count(*) AS n FROM (SELECT coalesce(mode, 'unknown') AS m, coalesce(provenance, 'unknown') AS p FROM documents) GROUP BY CUBE (m, p)",
    "revenue_rollup": "SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2)::DOUBLE AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)",
    "top_parts": "SELECT * FROM (SELECT l_suppkey, l_partkey, sum(l_quantity)::DOUBLE AS quantity, row_number() OVER (PARTITION BY l_suppkey ORDER BY sum(l_quantity) DESC, l_partkey) AS place FROM lineitem GROUP BY l_suppkey, l_partkey) WHERE place <= 3",
    "events_by_hour": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "customers_without_orders": "SELECT c_custkey AS custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
}
