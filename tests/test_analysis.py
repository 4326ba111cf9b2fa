import pytest
from pyspark.sql import functions as F

from prosescan.operators import behavior, contract, detectors, protected, scoring, voice
from prosescan.plans import lexicon, patterns


def fired(spark, text):
    docs = detectors.prepared(spark.createDataFrame([(1, text, "x")], "doc_id long, text string, language string"), "doc_id", "text")
    return {r.rule_id: r for r in detectors.findings(docs).collect()}


@pytest.mark.parametrize(
    ("text", "rule", "there"),
    [
        (" ".join(["The cat sat on the mat."] * 6), "rhythm.uniform_rhythm", True),
        ("Short. Also short. Still short.", "rhythm.uniform_rhythm", False),
        ("one — two — three — four " * 6, "rhythm.dash_overuse", True),
        ("a single — dash in a long enough line of text", "rhythm.dash_overuse", False),
        ("The parser reads. The parser writes. The parser waits. The parser ends.", "rhythm.repeated_openings", True),
        ("真的吗？？？哈哈。。。", "rhythm.repeated_openings", False),
        ("Red, green, and blue.", "rhythm.forced_triad", False),
        ("Red, green, and blue. Up, down, and out. Salt, oil, and time.", "rhythm.forced_triad", True),
        ("\n".join(f"**Label{i}:** x" for i in range(5)), "formatting.bold_decoration", True),
        ("# The Great Big Heading\ntext\n# Another Great Big Heading\ntext", "formatting.decorative_headings", True),
        ("# Parser Error Recovery\n\nParser error recovery matters.\n", "structural.heading_restated", True),
        ("This is not a tool but a mirror.", "structural.negation_contrast", True),
        ("The cat sat on the mat.", "structural.negation_contrast", False),
        ("Certainly! Here you are.", "assistant.chatbot_residue", True),
        ("这个方案可以赋能团队，形成闭环。底层逻辑在这里。", "structural.abstract_verb_swallows_action", True),
    ],
)
def test_detectors(spark, text, rule, there):
    assert (rule in fired(spark, text)) is there


def test_null_empty_and_very_long_texts_have_no_findings(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 200_000), (4, "word " * 40_000)], "doc_id long, text string")
    got = detectors.findings(detectors.prepared(rows, "doc_id", "text"))
    assert {r.doc_id for r in got.collect()} <= {4}
    assert detectors.findings(detectors.prepared(rows.limit(0), "doc_id", "text")).count() == 0
    assert detectors.findings(detectors.prepared(rows, "doc_id", "text"), families=[]).count() == 0


def test_lexical_features(spark):
    docs = detectors.prepared(spark.createDataFrame([(1, "The cat sat. The cat ran. The cat slept.")], "doc_id long, text string"), "doc_id", "text")
    x = detectors.lexical_features(F.col("text"))
    r = docs.select(*[c.alias(k) for k, c in x.items()]).withColumn("score", detectors.statistical_score(F.col("ttr"), F.col("cv"), F.col("hapax"))).first()
    assert r.ttr == pytest.approx(5 / 9) and r.cv == 0 and r.hapax == pytest.approx(0.6) and r.score == pytest.approx(0.49382716049382713)


@pytest.mark.parametrize(("template", "text", "there"), [
    ("X is the Y of Z", "Symmetry is the language of trust.", True), ("X is the Y of Z", "One is here. The other of them is gone.", False), ("as of [date]", "As of 2026 the rules changed.", True), ("as of [date]", "The list is as follows.", False),
    ("likely [grew up, studied, began]", "She likely grew up nearby.", True), ("likely [grew up, studied, began]", "That is likely.", False), ("让 X 成为可能", "这项技术让协作成为可能。", True),
])
def test_templates(spark, template, text, there):
    p = patterns.template("r", template)
    assert spark.range(1).select(F.lit(text).rlike(p.pattern)).first()[0] is there
    assert not there or not p.needles or any(n in text.lower() for n in p.needles)


def test_rejected_templates():
    assert all(patterns.template("r", t) is None for t in ("the reversed form X rather than Y", "", "   ", "X"))
    assert patterns.too_common("the") and patterns.too_common("你好") and not patterns.too_common("deep dive")


F_SCHEMA = "doc_id long, text string, found array<struct<rule_id:string,detector_id:string,family:string,severity:int,confidence:double,evidence:array<struct<start:int,end:int,text:string>>>>"


def test_collapse_and_score(spark):
    rows = [(1, "", [("r", "d", "lexical", 3, 0.5, [(0, 1, "a")]), ("r", "e", "lexical", 5, 0.4, [(2, 3, "b")]), ("r", "f", "lexical", 5, 0.45, [])]), (2, "", [("s", "d", "lexical", 5, 1.0, [])]), (3, "", [("t", "d", "assistant", 5, 1.0, [])]), (4, "", [])]
    got = {r.doc_id: r for r in scoring.scanned(spark.createDataFrame(rows, F_SCHEMA)).withColumn("c", scoring.contributions(F.col("merged"))).collect()}
    one = got[1].merged[0]
    # the second claim is graver; the third is as grave, but no surer than the surest so far
    assert len(got[1].merged) == 1 and one.severity == 5 and one.confidence == 0.5 and [e.text for e in one.evidence] == ["a", "b"] and one.detector_id == "e"
    assert got[2].anti_ai_score == pytest.approx(1 - 1 / 8) and got[3].anti_ai_score == 1 and got[4].anti_ai_score == 1
    assert [(c.label, c.value) for c in got[1].c] == [("r", 0.5)] and got[3].c == []


def test_suppression(spark):
    weak = "lexical.stacked_qualifiers"
    row = lambda r, s: (r, "d", "lexical", 3, 0.5, [(s, s + 1, "x")])
    rows = [
        (1, 'He said "a bad word here" and left.', [row("lexical.ai_vocabulary", 12)]), (2, "plain", [row(weak, 0), row("lexical.ai_vocabulary", 0), row("lexical.restatement", 0)]), (3, "plain", [row(weak, 0)]),
        (4, "plain", [row(weak, 0), row("lexical.passive_and_subjectless", 0)]), (5, "# Title\n`x`", [("r", "d", "lexical", 3, 0.5, [(9, 10, "x"), (0, 1, "#")])]), (6, "plain", [("r", "d", "lexical", 3, 0.5, [])]),
    ]
    why = {r.doc_id: [f.reason for f in r.judged] for r in scoring.scanned(spark.createDataFrame(rows, F_SCHEMA)).collect()}
    assert why == {1: ["inside a quotation"], 2: [None] * 3, 3: ["weak alone"], 4: ["weak alone"] * 2, 5: ["inside a code"], 6: [None]}
    old = {r.doc_id: [f.reason for f in r.judged] for r in scoring.scanned(spark.createDataFrame(rows, F_SCHEMA), predates=True).collect()}
    assert all(x is None for xs in old.values() for x in xs)


def test_findings_in_headings_are_exempt(spark):
    from prosescan.plans import api

    text = "# Parser Error Recovery\n## Details\n\nParser error recovery matters.\n"
    rows = api.scanned(detectors.prepared(spark.createDataFrame([(1, text), (2, "word " * 300)], "doc_id long, text string"), "doc_id", "text")).collect()
    found = {r.doc_id: {f.rule_id: f for f in r.judged} for r in rows}
    hit = found[1]["structural.heading_restated"]
    assert hit.reason == "inside a title" and hit.evidence[0].start == 0 and found[2].get("rhythm.uniform_rhythm") is None


def test_resolution(spark):
    found = spark.createDataFrame([("a", "u"), ("old", "u"), ("7", "u"), ("7", "v"), ("?", "u")], "rule_id string, upstream string")
    rules, aliases = spark.createDataFrame([("a",), ("b",)], "rule_id string"), spark.createDataFrame([("old", "b")], "alias string, rule_id string")
    claims = spark.createDataFrame([("u", "7", "b"), ("u", "7", "a")], "upstream string, upstream_rule_id string, rule_id string")
    got = {(r.rule_id, r.upstream): r.canonical_id for r in scoring.resolved(found, rules, aliases, claims).collect()}
    assert got == {("a", "u"): "a", ("old", "u"): "b", ("7", "u"): "a", ("7", "v"): None, ("?", "u"): None}


REPLY = "id long, text string, user_turn string, advice_permission string"


@pytest.mark.parametrize(("reply", "turn", "permission", "rule", "outcome"), [
    ("I hope this helps. Let me know if you want more.", None, None, "chat.unsolicited_offer", "fired"),
    ("I understand how frustrating that must be. Let us look at the logs.", None, None, "chat.mechanical_empathy", "fired"),
    ("Great question! Here is the answer.", None, None, "chat.forced_positivity", "fired"),
    ("The build is green. In summary, the work is complete.", None, None, "chat.auto_summary", "fired"),
    ("You may want to restart the worker first.", "why is the queue stuck", "absent", "chat.unsolicited_advice", "fired"),
    ("You may want to restart the worker first.", "why is the queue stuck", None, "chat.unsolicited_advice", "abstained"),
    ("You may want to restart the worker first.", "why is the queue stuck", "granted", "chat.unsolicited_advice", "suppressed"),
    ("You are asking about the queue being stuck. The queue is stuck because a worker died.", "why is the queue stuck", None, "chat.mirrors_user", "fired"),
    ("A worker died and never released its lock.", "why is the queue stuck", None, "chat.mirrors_user", "quiet"),
    (" ".join(f"Point {i} about the queue and its workers and the locks they hold." for i in range(9)), "why is the queue stuck", None, "chat.over_completeness", "fired"),
    ("A worker died. Restart it.", "why is the queue stuck", None, "chat.over_completeness", "quiet"),
    ("哈哈，确实挺离谱的！", None, None, "chat.over_agreement", "fired"), ("这个数据确实不对，我重新算一遍。", None, None, "chat.over_agreement", "quiet"),
    ("x", None, None, "chat.mirrors_user", "unjudged"), (None, "x", None, "chat.auto_summary", "quiet"),
])
def test_behavior(spark, reply, turn, permission, rule, outcome):
    got = behavior.outcomes(spark.createDataFrame([(1, reply, turn, permission)], REPLY), "id", "text")
    assert {r.rule_id: r.outcome for r in got.collect()}[rule] == outcome


def test_behavior_score_counts_only_discriminating_ones(spark):
    rows = [(1, "Great question! I understand how you feel. Absolutely, you are right. Let me know if you want more.", "a b c", None), (2, "Let me know if you want more.", None, None)]
    got = {r.reply_id: r for r in behavior.behavior_scores(spark.createDataFrame(rows, REPLY), "id", "text").collect()}
    assert got[1].behavior_score == pytest.approx(1 - (0.42 + 0.64 + 0.39) / 3) and got[2].behavior_score == 1 and got[2].unjudged == 2 and got[2].judged == 8


def test_previous_turn(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "assistant", "more"), (2, 0, "assistant", "first")]
    got = behavior.with_previous_turn(spark.createDataFrame(rows, "c long, n long, role string, text string"), "c", "n", "text", "role")
    assert {(r.c, r.n): r.user_turn for r in got.collect()} == {(1, 0): None, (1, 1): "hi", (1, 2): None, (2, 0): None}


def items(spark, text):
    return {(r.kind, r.value): r.occurrences for r in protected.protected_items(spark.createDataFrame([(1, text)], "id long, text string"), "id", "text").collect()}


def test_protected_items(spark):
    got = items(spark, "Use v3.0.0 of OpenClaw from https://x.org/a?b=1 on 2031-04-05, see `code 7` and [12].\nThe defaced wall costs 40 kg, run_all and 40 kg.")
    assert got["number", "3.0.0"] == 1 and got["url", "https://x.org/a?b=1"] == 1 and got["date", "2031-04-05"] == 1 and got["identifier", "OpenClaw"] == 1
    assert got["inline-code", "code 7"] == 1 and got["citation", "[12]"] == 1 and got["number", "40 kg"] == 2 and got["identifier", "run_all"] == 1
    assert not any(v == "defaced" for _, v in got)
    assert items(spark, None) == {} and items(spark, "") == {}


def test_preservation(spark):
    docs = spark.createDataFrame([(1, "Ada Lovelace met Ada Lovelace in 1843."), (2, "nothing")], "id long, text string")
    new = spark.createDataFrame([(1, "We saw Ada Lovelace."), (2, "x")], "id long, text string")
    states = protected.preservation(protected.protected_items(docs, "id", "text"), new, "id", "text")
    assert {r.value: (r.state, r.severity) for r in states.collect()} == {"Ada Lovelace": ("altered", 2), "1843": ("lost", 5)}
    docs = spark.createDataFrame([(3, 'OpenClaw said "Keep  it" here.')], "id long, text string")
    new = spark.createDataFrame([(3, "openclaw said “keep it” here.")], "id long, text string")
    assert {r.value: r.state for r in protected.preservation(protected.protected_items(docs, "id", "text"), new, "id", "text").collect()} == {"OpenClaw": "lost", "Keep  it": "lost"}
    got = protected.preservation_scores(states).collect()
    assert len(got) == 1 and got[0].preservation_score == 0


def test_voice(spark):
    docs = spark.createDataFrame([(1, "a", "One two three. Four five six."), (2, "a", "One two three. Four five six."), (3, "b", None), (4, "b", "")], "id long, g string, text string")
    texts = voice.features(docs, "id", "text", "g")
    prof = voice.profiles(texts, ["g"])
    assert [(r.g, r.sentence_n, r.sentence_mean, r.thin) for r in prof.collect()] == [("a", 4, 3.0, True)]
    got = {r.doc_id: r for r in voice.voice_scores(texts, prof, ["g"]).collect()}
    assert got[1].voice_score == 1 and set(got) == {1, 2}
    assert {r.doc_id: (r.mean, r.n) for r in voice.without_self(texts.where("n_sentences > 0"), ["g"]).collect()} == {1: (3.0, 2), 2: (3.0, 2)}
    row = spark.range(1).select(voice.content_units(F.lit("赋能 抓手 the Parser it's")).alias("u"), voice.punctuation_rates(F.lit("好。")).alias("p"), voice.chat_features(F.lit("a<!-- msg -->b<!-- msg -->c<!-- msg -->d?")).alias("c")).first()
    assert row.u == ["赋能", "能抓", "抓手", "parser"] or set(row.u) >= {"赋能", "抓手", "parser"}
    assert row.p["。"] == 500 and row.c.burst == 0.75 and row.c.question_rate == 0.25


def test_hazards(spark):
    row = spark.range(1).select(voice.hazards(F.array(F.lit("Invent numbers freely"), F.lit("keep it short"))).alias("h"), voice.neutralized(F.array(F.lit("bypass the detector"), F.lit("keep it short"))).alias("n")).first()
    assert [x.hazard for x in row.h] == ["fabricated-data"] and row.n == ["keep it short"]


@pytest.mark.parametrize(("text", "mode", "want"), [("hi there?", None, "en-chat"), ("你好吗？", "chat", "zh-chat"), ("plain text here", "prose", "en-prose"), ("see `x` now", None, "technical"), ("see `x` now", "unknown", "technical"), (None, None, "default")])
def test_strategy(spark, text, mode, want):
    got = contract.routed(spark.createDataFrame([(1, text, mode)], "id long, text string, mode string"), "id", "text", "mode").first()
    assert got.strategy == want


def test_composed_scores(spark):
    r = spark.range(1).select(scoring.composed(F.lit(0.5), F.lit(None).cast("double"), F.lit(1.0), F.lit(None).cast("double")).alias("s")).first().s
    assert r.unmeasured == ["voice_score", "preservation_score"]
    with pytest.raises(ValueError):
        scoring.assert_not_blended(spark.createDataFrame([], "overall double"))


def test_a_contract_keeps_every_rule_and_item(spark):
    from prosescan.operators import contract

    found = [(f"rule{i:02}", "d", "lexical", 5 - i % 5, 0.5, []) for i in range(25)]
    items = [("number", str(i), True, 1, (10, i)) for i in range(390)]
    schema = F_SCHEMA.replace("text string, found", "language string, mode string, strategy string, merged") + ", items array<struct<kind:string,value:string,exact:boolean,occurrences:int,ord:struct<k:int,pos:int>>>"
    rows = spark.createDataFrame([(1, "en", "chat", "en-chat", found, items), (2, "zh", "prose", "zh-prose", [], [])], schema)
    made = contract.contracts(rows, guidance={"rule03": "Do it."}, required=["Say it."], forbidden=["No lie."], behaviors=["Answer first."])
    one, two = made.withColumn("text", contract.rendered(F.col("contract"))).orderBy("doc_id").collect()
    assert (one.n_rules, one.n_protected) == (25, 390) and '"value":"389"' in one.contract
    assert "4. **rule03** (severity 2) — Do it." in one.text and "- `389` (number, exact)" in one.text and "- Answer first." in one.text and "- Say it." in one.text
    assert two.n_rules == 0 and "## Fix" not in two.text and "Answer first" not in two.text


def test_exempt_spans_have_no_limit(spark):
    from pyspark.sql import functions as F

    from prosescan.operators import scoring

    rows = spark.createDataFrame([("`a` 𝔘 " * 12_003,), ("",), ("x `b`",)], "text string").select(scoring.exempt_spans(F.col("text")).alias("s"))
    many, none, one = [[(x.start, x.end) for x in r.s if x.reason == "code"] for r in rows.collect()]
    assert many == [(6 * i, 6 * i + 3) for i in range(12_003)] and none == [] and one == [(2, 5)]
