import pytest
from pyspark.sql import functions as F

from prosescan.operators import evaluate, registry
from prosescan.sources import corpus

CAND = "rule_id long, upstream string, signature string, category string, severity int, weak_alone boolean, description string, detection string, rewrite_guidance string"


@pytest.mark.parametrize(("votes", "weak"), [([False, False, True], False), ([False, True, True], True), ([False, True], True), ([True], True)])
def test_weak_votes(spark, votes, weak):
    rows = [(i, f"u{i}", "a.b", "a", None, v, None, None, None) for i, v in enumerate(votes)]
    got = registry.canonical_rules(spark.createDataFrame(rows, CAND), None).first()
    assert got.weak_alone is weak and got.severity == 3


def test_one_upstream_with_many_claims_has_one_vote(spark):
    rows = [(i, "u", "a.b", "a", 2, True, None, None, None) for i in range(4)] + [(9, "v", "a.b", "c", 9, False, "text", None, None)]
    got = registry.canonical_rules(registry.clean_candidates(spark.createDataFrame(rows, CAND)), None).first()
    assert got.weak_alone and got.n_upstreams == 2 and got.category_conflict and got.severity == 5 and got.description == "text"
    assert registry.canonical_rules(spark.createDataFrame([], CAND), None).count() == 0


def test_severity_policies(spark):
    df = spark.createDataFrame([(1,), (2,), (5,), (None,)], "s int")
    r = df.agg(*[registry.severity_by(p, F.col("s")).alias(p) for p in ("max", "median", "mean")]).first()
    assert (r["max"], r["median"], r["mean"]) == (5, 2, 3)


def test_phrase_owners(spark):
    phrases = spark.createDataFrame([("wide", "x"), ("wide", "y"), ("wide", "z"), ("narrow", "x"), ("one", "y"), ("two", "y")], "rule string, text string")
    rules = spark.createDataFrame([("wide", 5), ("narrow", 1), ("one", 2), ("two", 4)], "rule string, severity int")
    got = {r.phrase_key: (r.owner, r.decided_by) for r in registry.phrase_owners(phrases, rules, F.col("text")).collect()}
    assert got == {"x": ("narrow", "fewest phrases"), "y": ("two", "fewest phrases"), "z": ("wide", "only claimant")}
    over = {r.phrase_key: r.owner for r in registry.phrase_owners(phrases, rules, F.col("text"), {"x": "wide"}).collect()}
    assert over["x"] == "wide"


def test_moves_and_aliases(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("a", "3")], "signature string, number string")
    new = spark.createDataFrame([("a", "5"), ("c", "6")], "signature string, number string")
    assert {r.signature: (r.old_number, r.new_number, r.outcome) for r in registry.renumbered(old, new).collect()} == {"a": ("1", "5", "carried"), "b": ("2", None, "dropped"), "c": (None, "6", "added")}
    r = spark.createDataFrame([("x",), ("p",), ("q",)], "s string").select(registry.resolved_signature(F.col("s"), {"x": "y", "y": "z", "p": "p"})).collect()
    assert [v[0] for v in r] == ["z", None, "q"]


@pytest.mark.parametrize(("a", "b", "want"), [([3, 4], [1, 2], 1.0), ([1, 2], [1, 2], 0.5), ([], [1], None), ([1.0, None], [1.0], 0.5)])
def test_separation(spark, a, b, want):
    df = spark.createDataFrame([(float(v) if v is not None else None, True) for v in a] + [(float(v), False) for v in b], "v double, s boolean")
    assert evaluate.separation(df, "v", "s").collect()[0].separation == want


def test_stratified_draw(spark):
    rows = spark.createDataFrame([(c, i + 1000 * k) for k, c in enumerate("abc") for i in range(120)], "cell string, pos long")
    got = evaluate.stratified_draw(rows, "cell", "pos", 120)
    assert {r.cell: r.n for r in evaluate.census(got, "cell").collect()} == {"a": 40, "b": 40, "c": 40}
    two = evaluate.stratified_draw(rows.where("cell < 'c'"), "cell", "pos", 5)
    assert sorted(r.n for r in evaluate.census(two, "cell").collect()) == [2, 3]
    assert evaluate.stratified_draw(rows, "cell", "pos", 1000).count() == 360
    assert evaluate.stratified_draw(rows, "cell", "pos", 0).count() == 0


def test_unmeasured_scores_are_counted_not_averaged(spark):
    rows = spark.createDataFrame([("c", 1.0, None, None, None), ("c", 0.5, None, None, None)], "config string, anti_ai_score double, voice_score double, behavior_score double, preservation_score double")
    got = {r.score: r for r in evaluate.summary_cells(rows, "config").collect()}
    assert got["anti_ai_score"].mean == 0.75 and got["voice_score"].mean is None and got["voice_score"].unmeasured == 2


def test_runs_and_corpus(spark, tmp_path):
    a = spark.createDataFrame([(1, 0.5), (2, 0.5)], "id long, s double")
    b = spark.createDataFrame([(2, 0.75), (3, 0.5)], "id long, s double")
    got = {r.id: (r.presence, r.s_delta) for r in evaluate.compare_runs(a, b, ["id"], ["s"]).collect()}
    assert got == {1: ("only before", None), 2: ("both", 0.25), 3: ("only after", None)}
    for name in ("r1", "r2"):
        corpus.save_run(a, str(tmp_path / "runs"), name, "hash")
    assert {r.run_id for r in corpus.load_run(spark, str(tmp_path / "runs")).collect()} == {"r2"}
    with pytest.raises(ValueError):
        corpus.save_run(a, str(tmp_path / "runs"), "r3", "")
    with pytest.raises(ValueError):
        corpus.contained("/a/b", "../c")


def test_samples(spark, tmp_path):
    folder = tmp_path / "english-chat"
    folder.mkdir()
    head = "---\nid: en-talk-{}\ncategory: english-chat\nlanguage: en\nmode: chat\nprovenance: human-written\nsource: own\nlicence: CC0\nnotes: >\n  two\n  lines\n---\n\nHello there.\n"
    (folder / "a.md").write_text(head.format("0001"))
    (folder / "b.md").write_text(head.format("0001").replace("mode: chat", "mode: odd"))
    (folder / "README.md").write_text("no sample")
    samples = corpus.parsed_samples(corpus.read_samples(spark, str(tmp_path)))
    rows = samples.collect()
    assert len(rows) == 2 and {r.notes for r in rows} == {"two lines"} and {r.body for r in rows} == {"Hello there."}
    assert {r.problem for r in corpus.violations(samples).collect()} == {"unknown mode", "duplicate id"}
    assert {r.category: r.state for r in corpus.corpus_counts(samples).collect()}["english-chat"] == "thin"


def test_corpus_hash_follows_content_not_order(spark):
    rows = [(i, f"text {i}") for i in range(50)]
    h = lambda x: corpus.corpus_hash(spark.createDataFrame(x, "id long, text string").repartition(3), "id", ["text"]).first()
    assert h(rows) == h(rows[::-1]) and h(rows).hash != h([*rows[1:], (0, "other")]).hash and h(rows).n == 50


def test_phrase_owners_of_all_scripts(spark, tmp_path):
    from prosescan.plans import evaluation

    spark.createDataFrame([(1, "wide", 3), (2, "narrow", 3)], "rule_id long, signature string, severity int").write.parquet(f"{tmp_path}/extracted_rules.parquet")
    texts = [(1, "综上所述"), (1, "值得注意"), (1, "Слово"), (1, "Naïve  idea!"), (1, "!?"), (2, "“综上所述。”"), (2, "not X, but Y")]
    spark.createDataFrame(texts, "rule_id long, text string").write.parquet(f"{tmp_path}/watch_phrases.parquet")
    got = {r.phrase_key: (r.owner, r.n_claimants) for r in evaluation.QUERIES["phrase_ownership"](spark, str(tmp_path)).collect()}
    assert got == {"综上所述": ("narrow", 2), "值得注意": ("wide", 1), "слово": ("wide", 1), "naïve idea": ("wide", 1), "not x, but y": ("narrow", 1)}


def test_false_positives_abstentions_and_verdicts(spark):
    samples = spark.createDataFrame([(1, "human-written"), (2, "human-written"), (3, "model-generated")], "doc_id long, provenance string")
    found = spark.createDataFrame([(1, "r"), (1, "r"), (3, "r"), (3, "s")], "doc_id long, rule_id string")
    assert [tuple(r) for r in evaluate.flagged_human_rules(found, samples, "doc_id").collect()] == [("r", 1, 0.5)]
    outcomes = spark.createDataFrame([(1, "a", "abstained"), (2, "a", "abstained"), (3, "a", "fired")], "reply_id long, rule_id string, outcome string")
    states = spark.createDataFrame([(1, "unknown", "default"), (2, "unknown", "explicit"), (3, "absent", "explicit")], "reply_id long, state string, source string")
    assert {tuple(r) for r in evaluate.abstentions(outcomes, states).collect()} == {("a", "unknown", "default", 1), ("a", "unknown", "explicit", 1)}
    seps = spark.createDataFrame([(None,), (0.7,), (0.2,), (0.5,)], "separation double")
    assert [r.verdict for r in evaluate.hypothesis(seps).collect()] == ["untested", "supported", "reversed", "not separated"]


def test_repeated_front_matter_keys_are_reported(spark):
    from prosescan.sources import corpus

    text = "---\nid: en-x-0001\nmode: chat\nmode: prose\n---\nbody\n"
    samples = corpus.parsed_samples(spark.createDataFrame([("p", "d", text)], "path string, directory string, text string"))
    assert samples.first().mode == "chat" and "repeated key" in {r.problem for r in corpus.violations(samples).collect()}
