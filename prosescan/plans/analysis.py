"""Queries over documents: text statistics, detectors, scores, behaviour, voice, protected content, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prosescan.functions import text as T
from prosescan.functions.scratch import materialize
from prosescan.operators import behavior, contract, detectors, evaluate, protected, scoring, voice
from prosescan.plans import api, lexicon, patterns
from prosescan.sources.tables import spread, table


def _docs(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    return detectors.prepared(table(spark, sf_dir, "documents"), "doc_id", "text", *keep)


def _long(*names: str) -> list[Column]:
    return [F.col(n).cast("bigint").alias(n) for n in names]


def _round(*names: str, places: int = 6) -> list[Column]:
    return [F.round(n, places).alias(n) for n in names]


def text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    rows = docs.select("doc_id", "language", *[c.alias(n) for n, c in T.text_statistics(F.col("text")).items()])
    return rows.select("doc_id", "language", *_long("n_chars", "n_cjk", "n_latin", "n_sentences", "n_tokens"), *_round("mean_length", "spread_length", "burstiness"))


def lexical_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    rows = docs.select("doc_id", *[c.alias(n) for n, c in detectors.lexical_features(F.col("text")).items()])
    rows = rows.withColumn("score", detectors.statistical_score(F.col("ttr"), F.col("cv"), F.col("hapax")))
    return rows.select("doc_id", *_long("n_types"), *_round("ttr", "cv", "hapax", "score"))


def rhythm_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    run = detectors.longest_run(F.transform(detectors.prose_sentences(F.col("sentences")), detectors.opening))
    dashes = T.count(F.col("text"), detectors.DASH)
    return docs.select("doc_id", dashes.cast("bigint").alias("n_dashes"), run.cast("bigint").alias("longest_run"), T.count(F.col("text"), detectors.TRIAD).cast("bigint").alias("n_triads"), ((dashes >= 3) & (T.per_thousand(dashes, F.char_length(F.col("text"))) >= 6)).alias("dash_overuse"))


def structure_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    heads = F.transform(T.extract(F.col("text"), detectors.HEADING, 1), T.trim_all)
    size = F.greatest(F.lit(1), F.char_length(F.col("text")))
    bolds, items = T.count(F.col("text"), detectors.BOLD), T.count(F.col("text"), detectors.LIST_ITEM)
    marks = F.size(heads) + items
    return docs.select(
        "doc_id", bolds.cast("bigint").alias("n_bold"), F.size(heads).cast("bigint").alias("n_headings"), F.size(F.filter(heads, detectors.title_case)).cast("bigint").alias("n_title_case"), items.cast("bigint").alias("n_items"),
        ((bolds >= 3) & (T.per_thousand(bolds, size) >= 12)).alias("bold_decoration"), ((marks >= 6) & (T.per_thousand(marks, size) >= 20)).alias("excessive_structure"), F.size(detectors.one_line_closers(F.col("text"))).cast("bigint").alias("n_closers"),
    )


def restated_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.size(detectors.restated_headings(F.col("text"))).cast("bigint").alias("n_restated"))


def chinese_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = detectors.translationese(F.col("text"))
    rows = _docs(spark, sf_dir).where("language = 'zh'").select("doc_id", *[c.alias(n) for n, c in s.items()], T.count(F.col("text"), "——|—").alias("n_dashes"), T.count(F.col("text"), "[，、]").alias("full_commas"), T.count(F.col("text"), detectors.HALF_COMMA).alias("half_commas"))
    fired = (F.col("n_cjk") >= 120) & (F.round("de_density", 2) >= 8) & (F.col("corroborating") >= 1)
    return rows.select("doc_id", *_long("n_cjk", "passive", "light_verb", "abstract", "pronoun", "corroborating", "n_dashes", "full_commas", "half_commas"), *_round("de_density"), fired.alias("translationese"))


def english_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, passives, dropped = F.size("words"), T.count(F.col("text"), detectors.PASSIVE), T.count(F.col("text"), detectors.SUBJECTLESS)
    gate = n >= 120
    rows = _docs(spark, sf_dir).where("language = 'en'")
    return rows.select("doc_id", n.cast("bigint").alias("n_words"), passives.cast("bigint").alias("n_passive"), dropped.cast("bigint").alias("n_subjectless"), (gate & (passives >= 3) & (T.per_thousand(passives, n) >= 12)).alias("passive"), (gate & (dropped >= 2)).alias("subjectless"))


#: A watch list of one's own beside the rules'.
OWN = [p for p in (patterns.literal("own.watch_list", t) for t in ("worth the walk", "in most cases", "no idea / not sure", "the build took", "Hm.", "大家都在", "只剩下 / 只好")) if p]


def _phrase_totals(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    each = detectors.phrase_counts(_docs(spark, sf_dir), [kind], OWN)
    return each.groupBy("rule_id", "phrase").agg(F.count("*").alias("n_docs"), F.sum("n").cast("bigint").alias("n_hits"))


def phrase_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and matches of every watched phrase; each document is read once for all phrases."""
    return _phrase_totals(spark, sf_dir, "literal")


def template_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _phrase_totals(spark, sf_dir, "template")


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.scanned(_docs(spark, sf_dir, "user_turn", "advice_permission"))


def scan_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding of every text with the reason for which it was suppressed, if it was; detectors and behaviours."""
    rows = _scanned(spark, sf_dir).select("doc_id", F.posexplode(T.each("judged")).alias("ord", "f")).select("doc_id", F.col("ord").cast("bigint").alias("ord"), "f.*")
    return rows.select("doc_id", "ord", "rule_id", "detector_id", "family", F.col("severity").cast("bigint").alias("severity"), "confidence", F.size("evidence").cast("bigint").alias("n_evidence"), "reason")


def scan_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass over the texts: findings, suppression, collapse and score within each text's row."""
    return _scanned(spark, sf_dir).select("doc_id", F.size("merged").cast("bigint").alias("n_findings"), *_round("anti_ai_score"))


def score_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule takes from a text's score."""
    rows = _scanned(spark, sf_dir).select("doc_id", F.inline(scoring.contributions(F.col("merged"))))
    return rows.select("doc_id", F.col("label").alias("rule_id"), "value", F.col("weight").cast("bigint").alias("severity"))


PROSE_TELLS = ["rhythm.uniform_rhythm", "rhythm.dash_overuse", "rhythm.repeated_openings", "rhythm.forced_triad", "formatting.bold_decoration", "lexical.low_lexical_diversity"]


def prose_tells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents ranked by their prose tells: six detectors, collapsed per rule, scored."""
    rows = detectors.with_findings(_docs(spark, sf_dir), only=(detectors.rhythm_detectors, detectors.structural_detectors, detectors.stylometry_detectors))
    merged = scoring.collapsed(F.filter("found", lambda f: f["rule_id"].isin(*PROSE_TELLS)))
    rows = rows.withColumn("merged", merged)
    return rows.select("doc_id", F.size("merged").cast("bigint").alias("n_findings"), F.round(scoring.anti_ai_score(F.col("merged")), 6).alias("anti_ai_score"), F.array_join(F.array_sort(F.transform("merged", lambda f: f["rule_id"])), ",").alias("rules"))


def findings_by_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts' collapsed findings by family."""
    return scoring.counts_by(_scanned(spark, sf_dir).select(F.inline(T.each("merged"))), "family")


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "user_turn", "advice_permission"))


def turn_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _replies(spark, sf_dir).where("user_turn is not null and text is not null")
    m = behavior.mirroring(F.col("text"), F.col("user_turn"))
    said, turn = F.size(T.sentences(F.col("text"))), F.greatest(F.lit(1), F.size(T.sentences(F.col("user_turn"))))
    over = (F.char_length("user_turn") <= behavior.SHORT_TURN) & (said > behavior.SENTENCES) & (said / turn >= behavior.RATIO)
    return rows.select("doc_id", *[c.cast("bigint").alias(n) for n, c in m.items()], over.alias("over_complete"))


def advice_permission(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _replies(spark, sf_dir)
    none = F.lit(None).cast("string")
    return rows.select("doc_id", behavior.advice_permission(F.col("advice_permission"), none, F.array().cast("array<string>")).alias("permission"))


def behavior_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = behavior.outcomes(_replies(spark, sf_dir), "doc_id", "text")
    return rows.groupBy("rule_id", "outcome").agg(F.count("*").alias("n"))


def behavior_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = behavior.behavior_scores(_replies(spark, sf_dir), "doc_id", "text")
    return rows.select(F.col("reply_id").alias("doc_id"), *_round("behavior_score"), *_long("abstained", "suppressed", "unjudged", "fired", "judged"))


def punctuation_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, "documents").where("text is not null")).select("lang", F.explode(voice.punctuation_rates(F.col("text"))).alias("mark", "rate"))
    return rows.groupBy("lang", "mark").agg(F.count("*").alias("n_docs"), F.round(F.avg("rate"), 3).alias("mean_rate"))


def _voices(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    return voice.features(spread(table(spark, sf_dir, "documents")), "doc_id", "text", *keep)


def signature_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = voice.signature_vocabulary(_voices(spark, sf_dir, "source"), ["source"])
    return rows.select("source", F.posexplode("vocabulary").alias("place", "unit")).select("source", F.col("place").cast("bigint").alias("place"), "unit")


def voice_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = voice.profiles(_voices(spark, sf_dir, "source"), ["source"])
    return rows.select("source", *_long("n_texts", "n_chars", "sentence_n", "paragraph_n"), *_round("sentence_mean", "sentence_spread", "paragraph_mean", "paragraph_spread", "burstiness"), "thin")


def _profiled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Features of all texts, computed once, and the profile of each source."""
    texts = materialize(_voices(spark, sf_dir, "source").drop("text"), "features")
    return texts, materialize(voice.profiles(texts, ["source"]), "profiles")


def voice_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voice.compare(*_profiled(spark, sf_dir), ["source"]).select("doc_id", "dimension", *_round("score"))


def voice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voice.voice_scores(*_profiled(spark, sf_dir), ["source"]).select("doc_id", *_long("n_dimensions"), *_round("voice_score"))


def leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = voice.without_self(_voices(spark, sf_dir, "source").where("n_sentences > 0"), ["source"])
    return rows.select("doc_id", F.round("mean", 6).alias("mean"), *_long("n"))


def chat_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat habits of every text, blank ones included: messages, their length, bursts, questions and emoji."""
    rows = spread(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).select("doc_id", voice.chat_features(F.col("text")).alias("c"))
    return rows.select("doc_id", F.col("c.reply_length.sample_count").cast("bigint").alias("n_messages"), F.col("c.reply_length.mean").alias("mean_length"), F.col("c.reply_length.median").alias("median_length"), "c.burst", "c.question_rate", "c.emoji_rate")


def refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that decline or package their task, by provenance."""
    rows = table(spark, sf_dir, "documents").select("provenance", evaluate.is_refusal(F.col("text")).alias("refused"))
    return rows.groupBy("provenance").agg(F.count("*").alias("n"), F.count_if("refused").alias("n_refused"))


def normalized_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Watched phrases whose form for matching differs from what was written."""
    form = T.normalized(F.col("text"))
    return table(spark, sf_dir, "watch_phrases").select("phrase_id", form.alias("form"), F.col("text")).where("form <> text").select("phrase_id", "form")


def voice_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _voices(spark, sf_dir, "provenance", "category")
    profiles = voice.profiles(texts, ["provenance", "category"])
    side = lambda p: profiles.where(F.col("provenance") == p).drop("provenance")
    rows = voice.drift(side("human-written"), side("model-generated"), ["category"])
    return rows.select("category", "dimension", *_round("baseline", "candidate"), F.round("deviations", 4).alias("deviations"), "drifted")


def protected_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = protected.protected_items(spread(table(spark, sf_dir, "documents")), "doc_id", "text")
    return rows.select("doc_id", "kind", "value", F.col("occurrences").cast("bigint").alias("occurrences"))


def protected_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return protected_items(spark, sf_dir).where("kind in ('quotation', 'citation', 'date', 'inline-code', 'url')")


def preservation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against itself with each odd ASCII digit written as 2, as if that were its rewrite: a digit edit, so that mostly items with such digits are altered or lost."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    rewritten = docs.select("doc_id", F.regexp_replace("text", "[13579]", "2").alias("text"))
    states = protected.preservation(protected.protected_items(docs, "doc_id", "text"), rewritten, "doc_id", "text")
    return protected.preservation_scores(states).select("doc_id", *_long("n_items", "kept", "altered", "lost"), *_round("preservation_score"))


def strategy_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = contract.routed(table(spark, sf_dir, "documents"), "doc_id", "text", "mode")
    return rows.groupBy("language", "mode", "strategy").agg(F.count("*").alias("n"), F.count_if("short").alias("n_short"))


def rewrite_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = api.prepare(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "mode")), "doc_id", "text", "mode")
    return rows.select("doc_id", "strategy", *_long("n_rules", "n_protected"), "contract")


QUERIES = {
    f.__name__: f
    for f in (
        text_stats, lexical_features, rhythm_signals, structure_signals, restated_headings, chinese_signals, english_signals, phrase_hits, template_hits, scan_findings, scan_scores, score_contributions, prose_tells,
        findings_by_family, turn_overlap, advice_permission, behavior_outcomes, behavior_scores, punctuation_rates, signature_vocabulary, voice_profiles, voice_dimensions, voice_scores, leave_one_out, chat_statistics, refusals, normalized_phrases,
        voice_drift, protected_items, protected_quotes, preservation_scores, strategy_routes, rewrite_contracts,
    )
}

# ---- SQL ----

SP = r"[\s\x0b\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
INK = r"[^\s\x0b\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
CJK = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]"
END = r".!?\n。！？；…"


def q(s: str) -> str:
    """A string literal."""
    return "'" + s.replace("'", "''") + "'"


def trim_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{SP}+|{SP}+$', '', 'g')"


def sentences_sql(x: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({x}, '[^{END}]*[{END}]|[^{END}]+'), lambda s: {trim_sql('s')}), lambda s: s <> '')"


def tokens_sql(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, '[A-Za-z0-9'']+|{CJK}'), lambda w: lower(w))"


def n_sql(x: str, p: str) -> str:
    return f"len(regexp_extract_all({x}, {q(p)}))"


LANGUAGE = f"CASE WHEN n_cjk + n_latin = 0 THEN 'unknown' WHEN n_cjk / (n_cjk + n_latin) >= 0.5 THEN 'zh' WHEN n_cjk / (n_cjk + n_latin) <= 0.05 THEN 'en' ELSE 'unknown' END"
DOCS = f"""
raw AS (SELECT *, coalesce(text, '') AS body FROM documents),
counted AS (SELECT *, {n_sql('body', CJK)} AS n_cjk, {n_sql('body', '[A-Za-z]')} AS n_latin FROM raw),
docs AS (
  SELECT *, {LANGUAGE} AS language, {sentences_sql('body')} AS sentences, {tokens_sql('body')} AS tokens, regexp_extract_all(body, '{INK}+') AS words FROM counted
),
lengths AS (SELECT *, list_transform(sentences, lambda s: len({tokens_sql('s')})::DOUBLE) AS lens FROM docs),
stats AS (
  SELECT *, coalesce(list_avg(lens), 0) AS mean_length, coalesce(list_stddev_pop(lens), 0) AS spread_length,
    CASE WHEN list_avg(lens) > 0 THEN list_stddev_pop(lens) / list_avg(lens) ELSE 0 END AS burstiness
  FROM lengths
)
"""
SPACED = f"list_filter(list_transform(regexp_split_to_array(regexp_replace(body, '([.!?]){SP}+', '\\1' || chr(1), 'g'), chr(1)), lambda s: {trim_sql('s')}), lambda s: s <> '')"
LEXICAL = f"""
spaced AS (SELECT doc_id, language, words, list_transform({SPACED}, lambda s: len(regexp_extract_all(s, '{INK}+'))::DOUBLE) AS slens FROM docs),
kinds AS (
  SELECT doc_id, count(*) AS n_types, count(*) FILTER (WHERE n = 1) AS once FROM (SELECT doc_id, lower(w) AS w, count(*) AS n FROM (SELECT doc_id, unnest(words) AS w FROM docs) GROUP BY ALL) GROUP BY doc_id
),
lex AS (
  SELECT s.doc_id, s.language, len(s.words) AS n_words, coalesce(k.n_types, 0) AS n_types, len(s.slens) >= 2 AND len(s.words) > 0 AS enough,
    CASE WHEN enough THEN k.n_types / len(s.words) END AS ttr, CASE WHEN enough THEN list_stddev_pop(s.slens) / list_avg(s.slens) END AS cv, CASE WHEN enough THEN k.once / k.n_types END AS hapax
  FROM spaced s LEFT JOIN kinds k USING (doc_id)
),
anchored AS (SELECT *, CASE WHEN enough THEN greatest(0, least(1, (0.7 - ttr) / 0.3)) END AS s_ttr, CASE WHEN enough THEN greatest(0, least(1, (0.5 - cv) / 0.3)) END AS s_cv, CASE WHEN enough THEN greatest(0, least(1, (0.6 - hapax) / 0.3)) END AS s_hapax FROM lex)
"""
RUNS = rf"""
parts AS (SELECT doc_id, unnest(sentences) AS s, generate_subscripts(sentences, 1) AS i FROM docs),
prose AS (
  SELECT doc_id, i, coalesce(nullif(lower(regexp_extract({trim_sql('s')}, '^([A-Za-z'']+)', 1)), ''), substring({trim_sql('s')}, 1, 2)) AS opening FROM parts
  WHERE NOT regexp_matches({trim_sql('s')}, '^(?:[-*+•·]|\d+[.)]|#{{1,6}}\s|\*\*|__|>\s)') AND regexp_matches(s, '[\p{{Han}}A-Za-z0-9]')
),
islands AS (SELECT doc_id, opening, row_number() OVER (PARTITION BY doc_id ORDER BY i) - row_number() OVER (PARTITION BY doc_id, opening ORDER BY i) AS g FROM prose),
runs AS (SELECT doc_id, max(n) AS longest_run FROM (SELECT doc_id, opening, g, count(*) AS n FROM islands GROUP BY ALL) GROUP BY doc_id)
"""
DASHES = "regexp_extract_all(body, '—|–|--|－')"
TRIADS = r"""regexp_extract_all(body, '(?i)\b[\w''-]+(?:\s+[\w''-]+){0,2},\s+[\w''-]+(?:\s+[\w''-]+){0,2},\s+and\s+[\w''-]+(?:\s+[\w''-]+){0,2}\b')"""
BOLDS = r"regexp_extract_all(body, '\*\*[^*\n]+\*\*')"
PASSIVES = r"""regexp_extract_all(body, '(?i)\b(?:is|are|was|were|be|been|being|am)\s+(?:\w+ed|known|made|given|taken|seen|done|shown|found|held|kept|left|met|paid|put|read|run|said|sold|sent|set|told|thought|understood|written|built|chosen|driven|felt|grown|lost|meant)\b')"""
DROPPED = r"""regexp_extract_all(body, '(?i)(?:^|[.!?]\s+)No\s+\w+\s+(?:is|are|was|were)\s+\w+ed\b')"""
VOICES = f"""
vtext AS (SELECT d.*, list_transform(sentences, lambda s: greatest(1, len({tokens_sql('s')}))::DOUBLE) AS slen,
  list_transform(list_filter(list_transform(regexp_split_to_array(body, '\\n{{2,}}'), lambda p: {trim_sql('p')}), lambda p: p <> '' AND NOT starts_with(p, '#')), lambda p: greatest(1, len({tokens_sql('p')}))::DOUBLE) AS plen FROM docs d),
voices AS (SELECT *, len(sentences) AS n_sent, coalesce(CASE WHEN list_avg(slen) > 0 THEN list_stddev_pop(slen) / list_avg(slen) END, 0) AS burst FROM vtext WHERE len(sentences) > 0)
"""


def profile_sql(by: str) -> str:
    keys = " AND ".join(f"x.{k} IS NOT DISTINCT FROM v.{k}" for k in by.split(", "))
    return f"""
vs AS (SELECT {by}, avg(v) AS m, stddev_pop(v) AS s, count(*) AS n FROM (SELECT {by}, unnest(slen) AS v FROM voices) GROUP BY ALL),
vp AS (SELECT {by}, avg(v) AS m, stddev_pop(v) AS s, count(*) AS n FROM (SELECT {by}, unnest(plen) AS v FROM voices) GROUP BY ALL),
vg AS (SELECT {by}, count(*) AS n_texts, sum(length(body))::BIGINT AS n_chars, avg(burst) AS burstiness FROM voices GROUP BY ALL),
prof AS (
  SELECT v.*, x.n AS sentence_n, x.m AS sentence_mean, x.s AS sentence_spread, coalesce(y.n, 0) AS paragraph_n, coalesce(y.m, 0) AS paragraph_mean, coalesce(y.s, 0) AS paragraph_spread
  FROM vg v JOIN vs x ON {keys} LEFT JOIN vp y ON {keys.replace('x.', 'y.')}
)"""


def _literal_values() -> str:
    rows = []
    for p in [*patterns.compiled()[0], *OWN]:
        if p.kind == "literal":
            word = lambda c: c.isascii() and (c.isalnum() or c == "_")
            body = "|".join(patterns.quoted(w) for w in p.spellings)
            plain = patterns.cjk_share(p.phrase) >= 0.5
            left = r"\b" if not plain and all(word(w[0]) for w in p.spellings) else ""
            right = r"\b" if not plain and all(word(w[-1]) for w in p.spellings) else ""
            rows.append(f"({q(p.rule_id)}, {q(p.phrase)}, {q(('' if plain else '(?i)') + left + '(?:' + body + ')' + right)})")
    return ", ".join(rows)


def _marker_sql(lang: str, text: str) -> str:
    opens, text = text.startswith("^"), text.removeprefix("^")
    body = patterns.quoted(text if lang == "zh" else text.strip())
    if lang == "en":
        body = rf"\b{body}" + (r"\b" if text[-1:].isalnum() else "")
    return rf"(?:^|[.!?。！？,，;；:：—\n]\s*){body}" if opens else body


def _smell_sql(smell: str) -> str:
    by = {lang: "|".join(_marker_sql(lang, m) for m in ms) for lang, ms in lexicon.markers()[smell].items()}
    return f"CASE WHEN smell_zh THEN regexp_matches(body, {q(by['zh'])}) ELSE regexp_matches(body, {q('(?i)' + by['en'])}) END"


def _outcome_sql(smell: str) -> str:
    hit = _smell_sql(smell)
    if smell == "chat.mirrors_user":
        return f"CASE WHEN user_turn IS NULL THEN 'unjudged' WHEN coalesce(n_user >= 3 AND n_shared / nullif(n_opening, 0) >= 0.6 AND n_shared / nullif(n_user, 0) >= 0.5, false) OR {hit} THEN 'fired' ELSE 'quiet' END"
    if smell == "chat.over_completeness":
        return "CASE WHEN user_turn IS NULL THEN 'unjudged' WHEN length(user_turn) <= 120 AND len(said) > 4 AND len(said) / greatest(1, len(asked)) >= 3 THEN 'fired' ELSE 'quiet' END"
    if smell == "chat.unsolicited_advice":
        return f"CASE WHEN {hit} THEN CASE advice_permission WHEN 'absent' THEN 'fired' WHEN 'granted' THEN 'suppressed' ELSE 'abstained' END ELSE 'quiet' END"
    return f"CASE WHEN {hit} THEN 'fired' ELSE 'quiet' END"


CONTENT = "list_distinct(list_filter({}, lambda w: length(w) > 1))"
SMELLS = f"""
smell_raw AS (SELECT doc_id, coalesce(text, '') AS body, user_turn, advice_permission FROM documents),
smell_base AS (
  SELECT *, {sentences_sql('body')} AS said, {sentences_sql("coalesce(user_turn, '')")} AS asked,
    {CONTENT.format(tokens_sql("array_to_string(list_slice(" + sentences_sql('body') + ", 1, 2), ' ')"))} AS opening_tokens, {CONTENT.format(tokens_sql("coalesce(user_turn, '')"))} AS user_tokens,
    coalesce({n_sql('body', chr(91) + r'^\x{0000}-\x{2FFF}\x{3000}\x{FEFF}]')} / nullif({n_sql('body', INK)}, 0) >= 0.3, false) AS smell_zh
  FROM smell_raw
),
smell_docs AS (SELECT *, len(list_intersect(opening_tokens, user_tokens)) AS n_shared, len(opening_tokens) AS n_opening, len(user_tokens) AS n_user FROM smell_base),
outcomes AS ({" UNION ALL ".join(f"SELECT doc_id, {q(s)} AS rule_id, {_outcome_sql(s)} AS outcome FROM smell_docs" for s in lexicon.smells())})
"""
CHARGES = " ".join(f"WHEN {q(s)} THEN {round(sev / 5 * behavior.CONFIDENCE[s], 4)}" for s, (sev, cls) in lexicon.smells().items() if cls == "discriminating")
STOPS = ", ".join(q(w) for w in voice.STOP_WORDS.split())

UNITS = f"""toks AS (SELECT doc_id, source, unnest(tokens) AS t, generate_subscripts(tokens, 1) AS i FROM docs),
pairs AS (SELECT *, lead(t) OVER (PARTITION BY doc_id ORDER BY i) AS u FROM toks),
units AS (
  SELECT doc_id, source, CASE WHEN length(t) > 1 THEN CASE WHEN t NOT IN ({STOPS}) THEN t END
    WHEN regexp_matches(t, '^{CJK}$') AND regexp_matches(u, '^{CJK}$') AND t NOT IN ({STOPS}) AND u NOT IN ({STOPS}) AND t || u NOT IN ({STOPS}) THEN t || u END AS unit FROM pairs
),
counts AS (SELECT source, unit, count(*) AS n FROM units WHERE unit IS NOT NULL GROUP BY ALL HAVING count(*) >= 2)"""

SQL = {
    "text_stats": f"WITH {DOCS} SELECT doc_id, language, length(body) AS n_chars, n_cjk, n_latin, len(sentences) AS n_sentences, len(tokens) AS n_tokens, round(mean_length, 6) AS mean_length, round(spread_length, 6) AS spread_length, round(burstiness, 6) AS burstiness FROM stats",
    "lexical_features": f"WITH {DOCS}, {LEXICAL} SELECT doc_id, n_types, round(ttr, 6) AS ttr, round(cv, 6) AS cv, round(hapax, 6) AS hapax, round(CASE WHEN enough THEN (s_ttr + s_cv + s_hapax) / 3 ELSE 0.5 END, 6) AS score FROM anchored",
    "rhythm_signals": f"WITH {DOCS}, {RUNS} SELECT doc_id, len({DASHES}) AS n_dashes, coalesce(longest_run, 0) AS longest_run, len({TRIADS}) AS n_triads, len({DASHES}) >= 3 AND len({DASHES}) * 1000.0 / length(body) >= 6 AS dash_overuse FROM docs LEFT JOIN runs USING (doc_id)",
    "structure_signals": rf"""
WITH {DOCS},
heads AS (SELECT doc_id, body, list_transform(regexp_extract_all(body, '(?m)^#{{1,6}}[ \t]+(.+)$', 1), lambda h: {trim_sql('h')}) AS hs, len({BOLDS}) AS n_bold, len(regexp_extract_all(body, '(?m)^\s*(?:[-*+]|\d+\.)\s+')) AS n_items,
  list_filter(list_transform(regexp_split_to_array(body, '\n{{2,}}'), lambda p: {trim_sql('p')}), lambda p: p <> '' AND NOT starts_with(p, '#')) AS ps FROM docs),
closers AS (
  SELECT doc_id, least(3, count(*)) AS n_closers FROM (
    SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM heads)
  ) WHERE len(regexp_extract_all(before, '{INK}+')) >= 40 AND len(regexp_extract_all(p, '{INK}+')) <= 12 AND len({sentences_sql('p')}) = 1 GROUP BY doc_id
)
SELECT doc_id, n_bold, len(hs) AS n_headings,
  len(list_filter(hs, lambda h: len(list_filter(regexp_extract_all(h, '{INK}+'), lambda w: regexp_matches(w, '[A-Za-z]'))) >= 3
    AND len(list_filter(regexp_extract_all(h, '{INK}+'), lambda w: regexp_matches(w, '^[A-Z]'))) / len(list_filter(regexp_extract_all(h, '{INK}+'), lambda w: regexp_matches(w, '[A-Za-z]'))) >= 0.8)) AS n_title_case,
  n_items, n_bold >= 3 AND n_bold * 1000.0 / greatest(1, length(body)) >= 12 AS bold_decoration,
  len(hs) + n_items >= 6 AND (len(hs) + n_items) * 1000.0 / greatest(1, length(body)) >= 20 AS excessive_structure, coalesce(n_closers, 0) AS n_closers
FROM heads LEFT JOIN closers USING (doc_id)
""",
    "chinese_signals": rf"""
WITH {DOCS},
zh AS (
  SELECT doc_id, n_cjk, {n_sql('body', '被')} AS passive, {n_sql('body', '进行|作出|加以|予以')} AS light_verb, {n_sql('body', r'[\x{4E00}-\x{9FFF}][性化度]')} AS abstract, {n_sql('body', '它们|它|他们|她们')} AS pronoun,
    {n_sql('body', '的')} * 100.0 / n_cjk AS de_density, {n_sql('body', '——|—')} AS n_dashes, {n_sql('body', '[，、]')} AS full_commas, {n_sql('body', r'[\x{4E00}-\x{9FFF}],|,[\x{4E00}-\x{9FFF}]')} AS half_commas FROM docs WHERE language = 'zh'
),
over AS (SELECT *, (passive >= 2)::BIGINT + (light_verb >= 3)::BIGINT + (abstract >= 6)::BIGINT + (pronoun >= 6)::BIGINT AS corroborating FROM zh)
SELECT doc_id, n_cjk, passive, light_verb, abstract, pronoun, corroborating, n_dashes, full_commas, half_commas, round(de_density, 6) AS de_density, n_cjk >= 120 AND round(de_density, 2) >= 8 AND corroborating >= 1 AS translationese FROM over
""",
    "english_signals": f"""
WITH {DOCS}, en AS (SELECT doc_id, len(words) AS n_words, len({PASSIVES}) AS n_passive, len({DROPPED}) AS n_subjectless FROM docs WHERE language = 'en')
SELECT doc_id, n_words, n_passive, n_subjectless, n_words >= 120 AND n_passive >= 3 AND n_passive * 1000.0 / n_words >= 12 AS passive, n_words >= 120 AND n_subjectless >= 2 AS subjectless FROM en
""",
    "phrase_hits": f"""
WITH watched(rule_id, phrase, pattern) AS (VALUES {_literal_values()}),
hits AS (SELECT rule_id, phrase, len(regexp_extract_all(text, pattern)) AS n FROM documents, watched WHERE regexp_matches(text, pattern))
SELECT rule_id, phrase, count(*) AS n_docs, sum(n)::BIGINT AS n_hits FROM hits GROUP BY ALL
""",
    "prose_tells": f"""
WITH {DOCS}, {LEXICAL}, {RUNS},
found AS (
  SELECT doc_id, 'rhythm.uniform_rhythm' AS rule_id, 4 AS sev, 0.75 AS conf FROM stats WHERE len(sentences) >= 5 AND burstiness < 0.35
  UNION ALL SELECT doc_id, 'rhythm.uniform_rhythm', 4, 0.45 FROM anchored WHERE language = 'en' AND n_words >= 150 AND n_types >= 40 AND s_cv >= 0.6
  UNION ALL SELECT doc_id, 'rhythm.dash_overuse', 4, 0.8 FROM docs WHERE len({DASHES}) >= 3 AND len({DASHES}) * 1000.0 / length(body) >= 6
  UNION ALL SELECT doc_id, 'rhythm.repeated_openings', 3, 0.85 FROM runs WHERE longest_run >= 3
  UNION ALL SELECT doc_id, 'rhythm.forced_triad', 3, 0.6 FROM docs WHERE len({TRIADS}) >= 3
  UNION ALL SELECT doc_id, 'formatting.bold_decoration', 3, 0.7 FROM docs WHERE len({BOLDS}) >= 3 AND len({BOLDS}) * 1000.0 / length(body) >= 12
  UNION ALL SELECT doc_id, 'lexical.low_lexical_diversity', 2, 0.45 FROM anchored WHERE language = 'en' AND n_words >= 150 AND n_types >= 40 AND (s_ttr + s_hapax) / 2 >= 0.5
),
merged AS (SELECT doc_id, rule_id, max(sev) AS sev, max(conf) AS conf FROM found GROUP BY ALL),
scored AS (SELECT doc_id, count(*) AS n, sum(sev / 5 * conf) AS w, string_agg(rule_id, ',' ORDER BY rule_id) AS rules FROM merged GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_findings, round(greatest(0, least(1, 1 - coalesce(w, 0) / 8)), 6) AS anti_ai_score, coalesce(rules, '') AS rules FROM documents LEFT JOIN scored USING (doc_id)
""",
    "turn_overlap": f"WITH {SMELLS} SELECT doc_id, n_shared, n_opening, n_user, length(user_turn) <= 120 AND len(said) > 4 AND len(said) / greatest(1, len(asked)) >= 3 AS over_complete FROM smell_docs WHERE user_turn IS NOT NULL AND doc_id IN (SELECT doc_id FROM documents WHERE text IS NOT NULL)",
    "advice_permission": "SELECT doc_id, coalesce(CASE WHEN advice_permission IN ('granted', 'absent', 'unknown') THEN advice_permission END, 'unknown') AS permission FROM documents",
    "behavior_outcomes": f"WITH {SMELLS} SELECT rule_id, outcome, count(*) AS n FROM outcomes GROUP BY ALL",
    "behavior_scores": f"""
WITH {SMELLS}
SELECT doc_id, round(greatest(0, least(1, 1 - sum(CASE WHEN outcome = 'fired' THEN CASE rule_id {CHARGES} ELSE 0 END ELSE 0 END) / 3)), 6)::DOUBLE AS behavior_score, count(*) FILTER (outcome = 'abstained') AS abstained,
  count(*) FILTER (outcome = 'suppressed') AS suppressed, count(*) FILTER (outcome = 'unjudged') AS unjudged, count(*) FILTER (outcome = 'fired') AS fired, 10 - count(*) FILTER (outcome = 'unjudged') - count(*) FILTER (outcome = 'abstained') AS judged
FROM outcomes GROUP BY doc_id
""",
    "punctuation_rates": f"""
WITH marks(mark) AS (VALUES {", ".join(f"({q(m)})" for m in voice.MARKS)}),
rates AS (SELECT lang, mark, round(((length(text) - length(replace(text, mark, ''))) / length(mark)) * 1000.0 / length(text), 4) AS rate FROM documents, marks WHERE text <> '')
SELECT lang, mark, count(*) AS n_docs, round(avg(rate), 3) AS mean_rate FROM rates WHERE rate > 0 GROUP BY ALL
""",
    "signature_vocabulary": f"""
WITH {DOCS},
{UNITS}
SELECT source, row_number() OVER (PARTITION BY source ORDER BY n DESC, unit) - 1 AS place, unit FROM counts QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, unit) <= 40
""",
    "voice_profiles": f"WITH {DOCS}, {VOICES}, {profile_sql('source')} SELECT source, n_texts, n_chars, sentence_n, paragraph_n, round(sentence_mean, 6) AS sentence_mean, round(sentence_spread, 6) AS sentence_spread, round(paragraph_mean, 6) AS paragraph_mean, round(paragraph_spread, 6) AS paragraph_spread, round(burstiness, 6) AS burstiness, sentence_n < 5 AS thin FROM prof",
    "voice_dimensions": f"""
WITH {DOCS}, {VOICES}, {profile_sql('source')}, {UNITS},
vocab AS (SELECT source, list(unit) AS v FROM (SELECT source, unit FROM counts QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, unit) <= 40) GROUP BY source),
mine AS (SELECT doc_id, list(unit) AS u FROM units WHERE unit IS NOT NULL GROUP BY doc_id),
marks(mark) AS (VALUES {", ".join(f"({q(m)})" for m in voice.MARKS)}),
rates AS (SELECT doc_id, source, mark, length(body) AS n, round(((length(body) - length(replace(body, mark, ''))) / length(mark)) * 1000.0 / length(body), 4) AS r FROM voices, marks),
prate AS (SELECT source, mark, round(sum(r * n) / sum(n), 4) AS p FROM rates GROUP BY ALL),
meet AS (SELECT r.doc_id, r.mark, r.r, p.p, sum(r.r) OVER d AS here, sum(p.p) OVER d AS there FROM rates r JOIN prate p ON p.source = r.source AND p.mark = r.mark WHERE r.r > 0 WINDOW d AS (PARTITION BY r.doc_id)),
punct AS (SELECT doc_id, any_value(here) AS here, CASE WHEN any_value(there) = 0 THEN 0.5 ELSE sum(abs(r / here - p / there)) / 2 END AS mix FROM meet GROUP BY doc_id),
ptotal AS (SELECT source, sum(p) AS whole FROM prate GROUP BY source),
every AS (
  SELECT d.doc_id, v.slen, v.plen, v.burst, p.*, w.v AS vocabulary, m.u AS units, x.here, x.mix, t.whole
  FROM docs d JOIN prof p USING (source) LEFT JOIN voices v ON v.doc_id = d.doc_id LEFT JOIN vocab w ON w.source = d.source LEFT JOIN mine m ON m.doc_id = d.doc_id LEFT JOIN punct x ON x.doc_id = d.doc_id LEFT JOIN ptotal t ON t.source = d.source
),
dims AS (
  SELECT doc_id, 'sentenceLength' AS dimension, CASE WHEN slen IS NOT NULL THEN 1 / (1 + greatest(0, abs(list_avg(slen) - sentence_mean) - greatest(sentence_spread, sentence_mean * 0.2, 1)) / greatest(sentence_spread, sentence_mean * 0.2, 1)) END AS score FROM every
  UNION ALL SELECT doc_id, 'burstiness', CASE WHEN slen IS NOT NULL THEN 1 / (1 + greatest(0, abs(burst - burstiness) - greatest(0.12, burstiness * 0.4)) / greatest(0.12, burstiness * 0.4)) END FROM every
  UNION ALL SELECT doc_id, 'paragraphLength', CASE WHEN paragraph_n > 0 AND len(plen) >= 3 THEN 1 / (1 + greatest(0, abs(list_avg(plen) - paragraph_mean) - greatest(paragraph_spread, paragraph_mean * 0.25, 1)) / greatest(paragraph_spread, paragraph_mean * 0.25, 1)) END FROM every
  UNION ALL SELECT doc_id, 'signatureVocabulary', CASE WHEN len(vocabulary) > 0 AND len(units) >= 40 THEN least(1, len(list_intersect(vocabulary, units)) / least(len(vocabulary), greatest(3, floor(len(units) / 25 + 0.5)))) END FROM every
  UNION ALL SELECT doc_id, 'punctuation', CASE WHEN whole > 0 AND here > 0 THEN greatest(0, least(1, 0.75 * greatest(0, least(1, 1 - mix * 2)) + 0.25 / (1 + greatest(0, abs(ln(greatest(here / whole, 1e-6))) - ln(2)) / ln(2)))) END FROM every
)
SELECT doc_id, dimension, round(score, 6) AS score FROM dims
""",
    "voice_scores": f"WITH dims AS ({{}}) SELECT doc_id, count(score) AS n_dimensions, round(sum(score * CASE dimension {' '.join(f'WHEN {q(k)} THEN {w}' for k, w in voice.WEIGHTS.items())} END) / sum(CASE WHEN score IS NOT NULL THEN CASE dimension {' '.join(f'WHEN {q(k)} THEN {w}' for k, w in voice.WEIGHTS.items())} END END), 6)::DOUBLE AS voice_score FROM dims GROUP BY doc_id",
    "chat_statistics": f"""
WITH said AS (
  SELECT doc_id, coalesce(text, '') AS body, list_filter(list_transform(string_split(coalesce(text, ''), '<!-- msg -->'), lambda m: {trim_sql('m')}), lambda m: m <> '') AS ms FROM documents
), sized AS (SELECT *, len(ms) AS n, list_transform(ms, lambda m: length(m)::DOUBLE) AS sizes FROM said)
SELECT doc_id, n AS n_messages, coalesce(round(list_avg(sizes), 4), 0)::DOUBLE AS mean_length, coalesce(round(list_median(sizes), 4), 0)::DOUBLE AS median_length, CASE WHEN n <= 1 THEN 0 ELSE round((n - 1) / n, 4) END::DOUBLE AS burst,
  coalesce(round(len(list_filter(ms, lambda m: regexp_matches(m, '[?？]'))) / nullif(n, 0), 4), 0)::DOUBLE AS question_rate,
  coalesce(round({n_sql('body', r'[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}\x{1F1E6}-\x{1F1FF}]')} / nullif(n, 0), 4), 0)::DOUBLE AS emoji_rate FROM sized
""",
    "refusals": f"SELECT provenance, count(*) AS n, count(*) FILTER (coalesce(regexp_matches(text, {q(evaluate.REFUSAL)}), false)) AS n_refused FROM documents GROUP BY provenance",
    "normalized_phrases": f"""
WITH forms AS (SELECT phrase_id, text, {trim_sql("regexp_replace(regexp_replace(regexp_replace(text, '[“”「」『』]', chr(34), 'g'), '[‘’]', chr(39), 'g'), '" + SP + "+', ' ', 'g')")} AS form FROM watch_phrases)
SELECT phrase_id, form FROM forms WHERE form <> text
""",
    "restated_headings": rf"""
WITH heads AS (
  SELECT doc_id, coalesce(text, '') AS body, unnest(regexp_extract_all(coalesce(text, ''), '(?m)^#{{1,6}}[ \t]+(.+)$')) AS line FROM documents
),
placed AS (SELECT doc_id, regexp_extract(line, '^#+[ \t]+(.+)$', 1) AS head, substr(body, strpos(body, line) + length(line)) AS after FROM heads),
firsts AS (SELECT doc_id, head, list_filter(list_transform(regexp_split_to_array(after, '\n\s*\n'), lambda b: {trim_sql('b')}), lambda b: b <> '' AND NOT starts_with(b, '#'))[1] AS below FROM placed),
keyed AS (SELECT doc_id, list_distinct(list_filter(regexp_extract_all(lower(head), '{INK}+'), lambda w: length(w) > 3)) AS keys, regexp_extract_all(lower({sentences_sql('below')}[1]), '{INK}+') AS words FROM firsts WHERE below IS NOT NULL),
hits AS (SELECT doc_id, count(*) AS n FROM keyed WHERE len(keys) > 0 AND len(list_filter(words, lambda w: list_contains(keys, regexp_replace(w, '[^a-z]', '', 'g')))) >= greatest(2, ceil(len(keys) * 0.7)) GROUP BY doc_id)
SELECT doc_id, least(3, coalesce(n, 0)) AS n_restated FROM documents LEFT JOIN hits USING (doc_id)
""",
    "leave_one_out": f"WITH {DOCS}, {VOICES}, {profile_sql('source')} SELECT v.doc_id, round((p.sentence_mean * p.sentence_n - list_sum(v.slen)) / nullif(p.sentence_n - v.n_sent, 0), 6) AS mean, p.sentence_n - v.n_sent AS n FROM voices v JOIN prof p USING (source)",
    "voice_drift": f"""
WITH {DOCS}, {VOICES}, {profile_sql('provenance, category')},
both_ AS (SELECT a.category, a.sentence_mean AS sa, a.sentence_spread AS ss, b.sentence_mean AS sb, a.paragraph_mean AS pa, a.paragraph_spread AS ps, b.paragraph_mean AS pb, a.paragraph_n AS pna, b.paragraph_n AS pnb
  FROM prof a JOIN prof b ON a.category = b.category WHERE a.provenance = 'human-written' AND b.provenance = 'model-generated'),
dims AS (
  SELECT category, 'writing.sentenceLength' AS dimension, sa AS baseline, sb AS candidate, abs(sb - sa) / greatest(ss, sa * 0.2, 1) AS d FROM both_
  UNION ALL SELECT category, 'writing.paragraphLength', pa, pb, abs(pb - pa) / greatest(ps, pa * 0.2, 1) FROM both_ WHERE pna > 0 AND pnb > 0
)
SELECT category, dimension, round(baseline, 6) AS baseline, round(candidate, 6) AS candidate, round(d, 4) AS deviations, round(d, 4) >= 2 AS drifted FROM dims
""",
    "protected_quotes": r"""
WITH raw AS (SELECT doc_id, text AS body, regexp_replace(text, '```.*?```|`[^`\n]+`|https?://[^\s<>()"''`。，）]+', ' ', 'gs') AS bare FROM documents WHERE text IS NOT NULL),
found AS (
  SELECT doc_id, 'inline-code' AS kind, unnest(list_transform(regexp_extract_all(body, '`[^`\n]+`'), lambda v: regexp_replace(v, '^`|`$', '', 'g'))) AS value FROM raw
  UNION ALL SELECT doc_id, 'url', unnest(regexp_extract_all(body, 'https?://[^\s<>()"''`。，）]+')) FROM raw
  UNION ALL SELECT doc_id, 'citation', unnest(regexp_extract_all(bare, '(?i)(?:doi:\s*10\.\d{4,9}/\S+|arXiv:\s*\d{4}\.\d{4,5}|\[\d{1,3}\])')) FROM raw
  UNION ALL SELECT doc_id, 'date', unnest(regexp_extract_all(bare, '\b\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2})?Z?)?\b')) FROM raw
  UNION ALL SELECT doc_id, 'quotation', unnest(list_transform(regexp_extract_all(bare, '“[^”\n]{2,200}”|「[^」\n]{2,200}」|"[^"\n]{2,200}"'), lambda v: regexp_replace(v, '^[“「"]|[”」"]$', '', 'g'))) FROM raw
),
clean AS (SELECT doc_id, kind, """ + trim_sql("value") + r""" AS value FROM found)
SELECT doc_id, kind, value, count(*) AS occurrences FROM clean WHERE value <> '' GROUP BY ALL
""",
    "strategy_routes": rf"""
WITH counted AS (SELECT doc_id, {trim_sql("coalesce(text, '')")} AS body, mode AS given, {n_sql("coalesce(text, '')", CJK)} AS n_cjk, {n_sql("coalesce(text, '')", '[A-Za-z]')} AS n_latin FROM documents),
routed AS (
  SELECT {LANGUAGE} AS language, coalesce(nullif(given, 'unknown'), CASE WHEN regexp_matches(body, '```|`[^`\n]+`') THEN 'technical' WHEN length(body) <= 240 AND regexp_matches(body, '[?？]') THEN 'chat' ELSE 'unknown' END) AS mode, length(body) BETWEEN 1 AND 240 AS short FROM counted
)
SELECT language, mode, CASE WHEN mode = 'chat' AND language = 'zh' AND short THEN 'zh-chat' WHEN mode = 'chat' AND language = 'en' AND short THEN 'en-chat' WHEN mode = 'chat' THEN 'chat-long-turn'
  WHEN language = 'zh' AND mode IN ('prose', 'unknown') THEN 'zh-prose' WHEN language = 'en' AND mode IN ('prose', 'unknown') THEN 'en-prose' WHEN mode IN ('formal', 'technical', 'public') THEN mode ELSE 'default' END AS strategy, count(*) AS n, count(*) FILTER (short) AS n_short
FROM routed GROUP BY ALL
""",
}
SQL["voice_scores"] = SQL["voice_scores"].replace("{}", SQL["voice_dimensions"].replace("round(score, 6)", "score"))
