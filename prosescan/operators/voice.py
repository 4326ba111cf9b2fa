"""Voice profiles: what a writer's texts have in common, and how far a text is from it.

A text's features are one struct; a profile is the same struct over the texts of a group, by
grouped aggregation. Comparison gives one row per text and dimension, so weights, gates and
unmeasured dimensions stay visible.

Defined results: a dimension that cannot be measured has a null score and no weight; a text with
none is unmeasured; empty texts don't take part in a profile.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosescan.functions import text as T
from prosescan.functions.numbers import blend_distributions, blend_rates, clamp_score, punctuation_score, tolerance_score
from prosescan.functions.scratch import small_or_shuffled
from prosescan.operators.behavior import has_marker
from prosescan.plans import lexicon

# Punctuation marks, stop words, shorthand, weights and limits.
MARKS = ["。", "，", "、", "；", "：", "！", "？", "…", "—", "“", ".", ",", ";", ":", "!", "?", "...", "-", '"', "'", "(", ")"]
CHAT_MARKS = ["。", "，", "！", "？", "~", "～", ".", ",", "!", "?"]
STOP_WORDS = (
    "的 了 是 在 我 你 他 她 它 们 这 那 有 和 与 就 也 都 而 但 不 很 会 要 把 被 给 对 从 到 个 一 上 下 里 中 着 过 呢 吧 啊 吗 哦 嗯 "
    "一个 我们 你们 他们 因为 所以 如果 但是 然后 什么 怎么 还是 或者 以及 这个 那个 可以 没有 自己 已经 就是 不是 时候 这样 那样 一些 一样 可能 应该 需要 觉得 知道 看到 "
    "the and for that this with you not are but have has was were its it's from they them their there what when which who will would can could should into than then some "
    "such only also just more most much very been being does did doing about because while where here each other onto over under after before between these those your our out"
)
SHORTHAND = {"zh": "233 2333 hhh hhhh xswl yyds www emmm awsl tql orz", "en": "lol lmao btw imo imho tbh afaik iirc fwiw tldr wrt"}
WEIGHTS = {
    "sentenceLength": 0.25, "burstiness": 0.15, "punctuation": 0.2, "paragraphLength": 0.1, "signatureVocabulary": 0.2, "avoidVocabulary": 0.15,
    "chatReplyLength": 0.1, "chatEmoji": 0.05, "chatBurst": 0.05, "behaviorAgreement": 0.05, "behaviorOffer": 0.05,
}
VOCABULARY, LEAST_COUNT, LEAST_UNITS, LEAST_PARAGRAPHS, THIN = 40, 2, 40, 3, 5
# Instructions that no profile may carry.
HAZARDS = {
    "fabricated-data": r"(?i)invent (?:a |an |the )?(?:(?:plausible|fake|specific|convincing|made[- ]up|new)\s+)*(?:number|numbers|data|statistic|statistics|figure|figures|detail|details|example|examples|quote|quotes|one|ones|it)\b|make up (?:a |the )?(?:number|numbers|data|statistics|facts?|quote|quotes|one)|fabricat\w*|编造|虚构|捏造|杜撰|假数据|编个数字|编一个数据",
    "invented-citation": r"(?i)invent (?:a |the )?(?:citation|citations|source|sources|reference|references)|fake (?:citation|citations|source|sources)|伪造(?:引用|出处|来源)",
    "persona-claim": r"You are writing in the voice of|you are writing in the voice of|must read like an authentic passage|Must read like an authentic passage|write (?:exactly )?(?:as|like) (?:if you were )?[A-Z\x{4E00}-\x{9FFF}]|Write (?:exactly )?(?:as|like) (?:if you were )?[A-Z\x{4E00}-\x{9FFF}]|冒充|扮演[^，。]{0,6}(?:本人|的声音)|以[^，。]{0,8}本人的(?:身份|口吻)",
    "detector-evasion": r"(?i)(?:bypass|defeat|evade|beat|fool) (?:the )?(?:ai )?(?:detector|detectors|detection)|绕过(?:AI)?检测|骗过(?:AI)?检测",
}


def punctuation_rates(text: Column, marks: Sequence[str] = MARKS, per: float = 1000.0) -> Column:
    """map of mark to its rate per so many characters; marks that don't occur are left out."""
    size = F.char_length(text)
    rates = F.array(*[F.struct(F.lit(m).alias("k"), F.round(F.coalesce(F.try_divide(T.literal_count(text, F.lit(m)) * F.lit(per), size), F.lit(0.0)), 4).alias("v")) for m in marks])
    return F.map_from_entries(F.filter(rates, lambda x: x["v"] > 0))


def content_units(text: Column) -> Column:
    """Latin words of more than one letter and pairs of neighbouring CJK characters, without stop words."""
    ts = T.tokens(text)
    cjk = lambda t: t.rlike(rf"^[{T.CJK}]\z")
    ok = lambda t: ~t.isin(*STOP_WORDS.split())

    def unit(x: Column) -> Column:
        t, after = x["t"], x["after"]
        return F.when(F.char_length(t) > 1, F.when(ok(t), t)).when(cjk(t) & F.coalesce(cjk(after), F.lit(False)) & ok(t) & ok(after) & ok(F.concat(t, after)), F.concat(t, after))

    pairs = F.filter(F.arrays_zip(ts.alias("t"), F.slice(ts, 2, 2_000_000_000).alias("after")), lambda x: x["t"].isNotNull())
    return F.filter(F.transform(pairs, unit), lambda u: u.isNotNull())


def with_features(rows: DataFrame) -> DataFrame:
    """Rows (text, language) with n_chars, n_sentences, sentence_lengths, paragraph_lengths, burstiness, rates and units of their text."""
    text = F.col("text")
    lengths = lambda parts: F.transform(parts, lambda x: F.greatest(F.lit(1.0), F.size(T.tokens(x)).cast("double")))
    rows = rows.withColumns({"sentence_lengths": lengths(T.sentences(text)), "paragraph_lengths": lengths(T.paragraphs(text))})
    return rows.withColumns({"burstiness": T.variation(T.moments(F.col("sentence_lengths"))), "n_chars": F.char_length(text), "n_sentences": F.size("sentence_lengths"), "rates": punctuation_rates(text), "units": content_units(text)})


def features(docs: DataFrame, doc_id: str, text: str, *keep: str) -> DataFrame:
    """(doc_id, kept columns, text, language, n_chars, n_sentences, sentence_lengths, paragraph_lengths, burstiness, rates, units) of each text."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), *keep, F.coalesce(F.col(text), F.lit("")).alias("text"))
    return with_features(rows.withColumn("language", T.language(F.col("text"))))


def chat_features(text: Column) -> Column:
    """struct of reply lengths, burst, questions, emoji, punctuation and shorthand of a chat sample."""
    ms = T.messages(text)
    n = F.size(ms)
    share = lambda x: F.coalesce(F.round(F.try_divide(x, n), 4), F.lit(0.0))
    lang = T.language(text)
    short = [F.when((lang == k) & text.rlike(rf"(?i)(?:^|[^A-Za-z0-9]){w}(?:\z|[^A-Za-z0-9])"), F.lit(w)) for k, ws in SHORTHAND.items() for w in ws.split()]
    return F.struct(
        T.distribution(F.transform(ms, lambda m: F.char_length(m).cast("double"))).alias("reply_length"),
        F.when(n <= 1, 0.0).otherwise(F.round((n - 1) / n, 4)).alias("burst"),
        share(F.size(F.filter(ms, lambda m: m.rlike("[?？]")))).alias("question_rate"),
        share(T.count(text, T.EMOJI)).alias("emoji_rate"),
        punctuation_rates(text, CHAT_MARKS, 100.0).alias("punctuation"),
        F.array_compact(F.array(*short)).alias("shorthand"),
    )


def signature_vocabulary(texts: DataFrame, by: Sequence[str], most: int = VOCABULARY, least: int = LEAST_COUNT) -> DataFrame:
    """(by, vocabulary): the most frequent content units of each group, that occur often enough."""
    counts = texts.select(*by, F.explode(T.each("units")).alias("unit")).groupBy(*by, "unit").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "unit"))).where(F.col("rank") <= most)
    return ranked.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("rank", "unit"))).alias("v")).select(*by, F.col("v.unit").alias("vocabulary"))


def _pooled(values: Column) -> dict[str, Column]:
    return {"sum": F.sum(F.aggregate(values, F.lit(0.0), lambda a, x: a + x)), "squares": F.sum(F.aggregate(values, F.lit(0.0), lambda a, x: a + x * x)), "n": F.sum(F.size(values))}


def profiles(texts: DataFrame, by: Sequence[str]) -> DataFrame:
    """One profile per group of feature rows: exact pooled distributions of sentence and paragraph length, mean burstiness, rates weighted by characters, vocabulary."""
    some = texts.where("n_sentences > 0")
    pooled = []
    for name in ("sentence", "paragraph"):
        for k, c in _pooled(F.col(f"{name}_lengths")).items():
            pooled.append(c.alias(f"{name}_{k}"))
    # one sum per mark, so that one pass over the texts gives everything but the vocabulary
    weighed = [F.sum(F.coalesce(F.try_element_at("rates", F.lit(m)), F.lit(0.0)) * F.col("n_chars")).alias(f"mark_{i}") for i, m in enumerate(MARKS)]
    base = some.groupBy(*by).agg(*pooled, *weighed, F.avg("burstiness").alias("burstiness"), F.sum("n_chars").alias("n_chars"), F.count("*").alias("n_texts"))
    for name in ("sentence", "paragraph"):
        m = F.try_divide(F.col(f"{name}_sum"), F.col(f"{name}_n"))
        v = F.greatest(F.lit(0.0), F.try_divide(F.col(f"{name}_squares"), F.col(f"{name}_n")) - m * m)
        base = base.withColumn(f"{name}_mean", F.coalesce(m, F.lit(0.0))).withColumn(f"{name}_spread", F.coalesce(F.sqrt(v), F.lit(0.0))).drop(f"{name}_sum", f"{name}_squares")
    rates = F.array(*[F.struct(F.lit(m).alias("k"), F.round(F.coalesce(F.try_divide(F.col(f"mark_{i}"), F.col("n_chars")), F.lit(0.0)), 4).alias("v")) for i, m in enumerate(MARKS)])
    base = base.withColumn("rates", F.map_from_entries(F.filter(rates, lambda x: x["v"] > 0))).drop(*[f"mark_{i}" for i in range(len(MARKS))])
    out = base.join(signature_vocabulary(some, by), list(by), "left")
    return out.withColumn("vocabulary", F.coalesce("vocabulary", F.array().cast("array<string>"))).withColumn("thin", F.col("sentence_n") < THIN)


def without_self(texts: DataFrame, by: Sequence[str]) -> DataFrame:
    """(doc_id, mean, spread, n): each text's group distribution of sentence length without the text itself, as total minus own."""
    own = texts.select("doc_id", *by, F.aggregate("sentence_lengths", F.lit(0.0), lambda a, x: a + x).alias("s"), F.aggregate("sentence_lengths", F.lit(0.0), lambda a, x: a + x * x).alias("q"), F.col("n_sentences").alias("n"))
    whole = own.groupBy(*by).agg(F.sum("s").alias("ts"), F.sum("q").alias("tq"), F.sum("n").alias("tn"))
    rest = own.join(whole, list(by))
    n = F.col("tn") - F.col("n")
    m = F.try_divide(F.col("ts") - F.col("s"), n)
    v = F.greatest(F.lit(0.0), F.try_divide(F.col("tq") - F.col("q"), n) - m * m)
    return rest.select("doc_id", m.alias("mean"), F.sqrt(v).alias("spread"), n.alias("n"))


def with_dimensions(texts: DataFrame, profile: DataFrame, by: Sequence[str], avoid: str | None = None, chat: str | None = None, behavior: str | None = None) -> DataFrame:
    """Rows of ``with_features`` with ``dimensions``: an array of (dimension, score, weight) against their group's profile, and ``p_sentence``; null without a profile.

    ``profile`` has one row per group and must be cheap to count: it is broadcast if it is small, else the texts are shuffled by group.
    ``avoid`` (array), ``chat`` (chat_features struct) and ``behavior`` (struct<agreement, offer>) name optional profile columns, the
    columns of ``texts`` that only they need being ``text``. A score is null where it cannot be measured.
    """
    kept = texts.columns
    p = profile.select(*by, *[F.col(c).alias(f"p_{c}") for c in profile.columns if c not in by])
    p = small_or_shuffled(p)
    rows = texts.join(p, list(by), "left") if by else texts.crossJoin(F.broadcast(p.limit(1)))
    c = F.col
    mean = T.mean(T.moments(c("sentence_lengths")))
    wide = lambda *xs: F.greatest(*xs, F.lit(1.0))
    gate = (c("p_sentence_n") > 0) & (c("n_sentences") > 0)
    dims = {
        "sentenceLength": F.when(gate, tolerance_score(F.abs(mean - c("p_sentence_mean")), wide(c("p_sentence_spread"), c("p_sentence_mean") * 0.2))),
        "burstiness": F.when(gate, tolerance_score(F.abs(c("burstiness") - c("p_burstiness")), F.greatest(F.lit(0.12), F.abs(c("p_burstiness")) * 0.4))),
        "punctuation": F.when((F.size("p_rates") > 0) & (F.size("rates") > 0), punctuation_score(c("rates"), c("p_rates"))),
        "paragraphLength": F.when((c("p_paragraph_n") > 0) & (F.size("paragraph_lengths") >= LEAST_PARAGRAPHS), tolerance_score(F.abs(T.mean(T.moments(c("paragraph_lengths"))) - c("p_paragraph_mean")), wide(c("p_paragraph_spread"), c("p_paragraph_mean") * 0.25))),
        "signatureVocabulary": F.when((F.size("p_vocabulary") > 0) & (F.size("units") >= LEAST_UNITS), clamp_score(F.size(F.array_intersect("p_vocabulary", "units")) / F.least(F.size("p_vocabulary"), F.greatest(F.lit(3), F.floor(F.size("units") / 25 + 0.5).cast("int"))))),
    }
    if avoid:
        hits = F.size(F.filter(f"p_{avoid}", lambda t: F.contains(c("text"), t)))
        dims["avoidVocabulary"] = F.when(F.size(f"p_{avoid}") > 0, F.when(hits == 0, 1.0).otherwise(1 / (1 + hits)))
    if chat:
        k, ms = c(f"p_{chat}"), T.messages(c("text"))
        size = T.mean(T.moments(F.transform(ms, lambda m: F.char_length(m).cast("double"))))
        n = F.size(ms)
        dims["chatReplyLength"] = F.when((k["reply_length"]["sample_count"] > 0) & (n > 0), tolerance_score(F.abs(size - k["reply_length"]["mean"]), F.greatest(k["reply_length"]["std_dev"], k["reply_length"]["mean"] * 0.35, F.lit(10.0))))
        dims["chatEmoji"] = tolerance_score(F.abs(T.count(c("text"), T.EMOJI) / F.greatest(F.lit(1), n) - k["emoji_rate"]), F.greatest(F.lit(0.5), k["emoji_rate"] * 0.5))
        dims["chatBurst"] = F.when(n > 1, tolerance_score(F.abs((n - 1) / n - k["burst"]), F.lit(0.34)))
    if behavior:
        b = c(f"p_{behavior}")
        clauses = F.greatest(F.lit(1), c("n_sentences") + T.count(c("text"), "[,，;；:：]"))
        agreed = F.when(has_marker(c("text"), "chat.over_agreement"), 1.0).otherwise(0.0)
        offered = F.when(has_marker(c("text"), "chat.unsolicited_offer"), 1.0).otherwise(0.0)
        dims["behaviorAgreement"] = F.when(c("n_sentences") > 0, tolerance_score(F.abs(agreed / clauses - b["agreement"]), F.greatest(F.lit(0.05), b["agreement"])))
        dims["behaviorOffer"] = F.when(c("n_sentences") > 0, tolerance_score(F.abs(offered - b["offer"]), F.lit(0.5)))
    each = F.array(*[F.struct(F.lit(name).alias("dimension"), score.cast("double").alias("score"), F.lit(WEIGHTS[name]).alias("weight")) for name, score in dims.items()])
    target = F.struct(c("p_sentence_mean").alias("mean"), c("p_sentence_spread").alias("spread"), c("p_sentence_n").alias("n"))
    there = c("p_sentence_n").isNotNull()
    return rows.withColumns({"dimensions": F.when(there, each), "p_sentence": F.when(there, target)}).select(*kept, "dimensions", "p_sentence")


def compare(texts: DataFrame, profile: DataFrame, by: Sequence[str], avoid: str | None = None, chat: str | None = None, behavior: str | None = None) -> DataFrame:
    """(doc_id, dimension, score, weight) of every dimension that a text has against its group's profile; see ``with_dimensions``."""
    return with_dimensions(texts, profile, by, avoid, chat, behavior).select("doc_id", F.inline(T.each("dimensions")))


def row_score(dimensions: Column) -> Column:
    """Weighted mean of the dimensions that were measured, null if none was."""
    measured = F.filter(dimensions, lambda d: d["score"].isNotNull())
    total = lambda f: F.aggregate(measured, F.lit(0.0), lambda a, d: a + f(d))
    return clamp_score(F.try_divide(total(lambda d: d["score"] * d["weight"]), total(lambda d: d["weight"])))


# Rule and least deficit of the dimensions that are reported.
REPORTED = {"sentenceLength": ("stylometry.fingerprint_sentence_length", 0.3), "punctuation": ("stylometry.fingerprint_punctuation", 0.5), "signatureVocabulary": ("stylometry.fingerprint_vocabulary", 0.6), "avoidVocabulary": ("stylometry.fingerprint_vocabulary", 0.3)}


def _short(d: Column, name: str) -> tuple[str, Column, Column, Column]:
    """Rule, whether a dimension falls short by its threshold, severity and confidence."""
    rule, least = REPORTED[name]
    own, avoided, missing = lexicon.severity(rule) or 3, name == "avoidVocabulary", 1 - d["score"]
    sure = F.greatest(F.lit(0.2), 0.35 + F.least(F.lit(1.0), missing) * 0.35 + (0.2 if avoided else 0.0) - (0.1 if "Vocabulary" in name else 0.0))
    return rule, (d["dimension"] == name) & (missing >= least), F.lit(min(5, own + 1) if avoided else max(1, own - 1)), F.round(sure, 2)


def voice_findings(sigmas: float = 1.5) -> Column:
    """Findings of a row that has ``rhythm``, ``n_sentences``, ``p_sentence`` and ``dimensions``: its mean sentence length off the profile's by so many deviations, and each dimension that falls short."""
    none = F.array().cast("array<struct<start:int,end:int,text:string>>")
    made = lambda rule, detector, severity, sure: F.struct(F.lit(rule).alias("rule_id"), F.lit(detector).alias("detector_id"), F.lit("stylometry").alias("family"), severity.cast("int").alias("severity"), sure.cast("double").alias("confidence"), none.alias("evidence"))
    p, rule = F.col("p_sentence"), "stylometry.distribution_distance"
    wide = F.when(p["spread"] > 0, p["spread"]).otherwise(F.greatest(F.lit(1.0), p["mean"] * 0.3))
    off = F.abs(F.coalesce(T.mean(F.col("rhythm")), F.lit(0.0)) - p["mean"]) / wide >= sigmas
    distance = F.when((p["n"] > 0) & off, made(rule, "stylometry.voice_distance", F.lit(lexicon.severity(rule)), F.when(p["n"] >= 20, 0.6).otherwise(0.35)))

    def each(d: Column) -> Column:
        out = F.lit(None)
        for name in REPORTED:
            rule, over, severity, sure = _short(d, name)
            out = F.when(over, made(rule, "stylometry.fingerprint_features", severity, sure)).otherwise(out)
        return out

    every = F.concat(F.array(distance), F.coalesce(F.transform("dimensions", each), F.array()))
    return F.filter(every, lambda f: f.isNotNull())


def dimension_findings(dimensions: DataFrame) -> DataFrame:
    """(doc_id, rule_id, dimension, severity, confidence): dimensions that fall short of the profile by more than their threshold."""
    d = F.struct("dimension", "score")
    found = [_short(d, name) for name in REPORTED]
    structs = F.array(*[F.when(over, F.struct(F.lit(rule).alias("rule_id"), severity.alias("severity"), sure.alias("confidence"))) for rule, over, severity, sure in found])
    return dimensions.select("doc_id", "dimension", F.inline(F.filter(structs, lambda f: f.isNotNull()))).select("doc_id", "rule_id", "dimension", "severity", "confidence")


def voice_scores(texts: DataFrame, profile: DataFrame, by: Sequence[str]) -> DataFrame:
    """(doc_id, n_dimensions, voice_score) of feature rows: weighted mean of what was measured, null if nothing was; folded within the row."""
    rows = with_dimensions(texts, profile, by)
    return rows.where("dimensions is not null").select("doc_id", F.size(F.filter("dimensions", lambda d: d["score"].isNotNull())).alias("n_dimensions"), row_score(F.col("dimensions")).alias("voice_score"))


def worsened(before: DataFrame, after: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """(doc_id, dimension, before, after, delta, regressed) of dimensions measured on both sides."""
    b = before.select("doc_id", "dimension", F.col("score").alias("before"))
    both = b.join(after.select("doc_id", "dimension", F.col("score").alias("after")), ["doc_id", "dimension"]).where("before is not null and after is not null")
    return both.withColumn("delta", F.col("after") - F.col("before")).withColumn("regressed", F.col("delta") < -tolerance)


def drift(old: DataFrame, new: DataFrame, by: Sequence[str], sigmas: float = 2.0) -> DataFrame:
    """(by, dimension, baseline, candidate, deviations, drifted) of groups that have both profiles."""
    a, b = (x.select(*by, *[F.col(c).alias(f"{s}_{c}") for c in ("sentence_mean", "sentence_spread", "sentence_n", "paragraph_mean", "paragraph_spread", "paragraph_n")]) for x, s in ((old, "a"), (new, "b")))
    rows = []
    for name in ("sentence", "paragraph"):
        spread = F.greatest(F.col(f"a_{name}_spread"), F.col(f"a_{name}_mean") * 0.2, F.lit(1.0))
        there = (F.col(f"a_{name}_n") > 0) & (F.col(f"b_{name}_n") > 0)
        rows.append(F.when(there, F.struct(F.lit(f"writing.{name}Length").alias("dimension"), F.col(f"a_{name}_mean").alias("baseline"), F.col(f"b_{name}_mean").alias("candidate"), F.round(F.abs(F.col(f"b_{name}_mean") - F.col(f"a_{name}_mean")) / spread, 4).alias("deviations"))))
    each = a.join(b, list(by)).select(*by, F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("d")).select(*by, "d.*")
    return each.withColumn("drifted", F.col("deviations") >= sigmas)


def blend(a: Column, b: Column, weight: Column) -> Column:
    """struct of two profiles' distributions, rates and vocabulary mixed; both are structs<sentence, rates, vocabulary>."""
    vocabulary = F.slice(F.array_union(a["vocabulary"], b["vocabulary"]), 1, VOCABULARY)
    return F.struct(blend_distributions(a["sentence"], b["sentence"], weight).alias("sentence"), blend_rates(a["rates"], b["rates"], weight).alias("rates"), vocabulary.alias("vocabulary"))


def hazards(directives: Column) -> Column:
    """array<struct<hazard, text>> of the hazardous ones among directives."""
    found = [F.transform(F.filter(directives, _matches(p)), _named(name)) for name, p in HAZARDS.items()]
    return F.flatten(F.array(*found))


def neutralized(directives: Column) -> Column:
    """Directives without the hazardous ones."""
    return F.filter(directives, lambda d: ~F.coalesce(d.rlike("|".join(f"(?:{p})" for p in HAZARDS.values())), F.lit(False)))


def _matches(pattern: str):
    return lambda d: d.rlike(pattern)


def _named(name: str):
    return lambda d: F.struct(F.lit(name).alias("hazard"), d.alias("text"))


def profile_for(scopes: DataFrame, owner: str, prefer: Sequence[str] = ()) -> DataFrame:
    """One profile per request (owner, language, mode) from scopes (owner, profile_id, kind, languages): the preferred one, else one of the language whose kind suits the mode."""
    wanted = F.array(*[F.lit(p) for p in prefer]) if prefer else F.array().cast("array<string>")
    place = F.array_position(wanted, F.col("profile_id"))
    by_mode = F.when(F.col("mode") == "chat", F.array_position(F.array(F.lit("chat"), F.lit("writing"), F.lit("mixed")), F.col("kind"))).otherwise(F.array_position(F.array(F.lit("writing"), F.lit("mixed"), F.lit("chat")), F.col("kind")))
    suits = scopes.where(F.array_contains("languages", F.col("language")))
    w = Window.partitionBy(owner, "language", "mode").orderBy(F.when(place > 0, place).otherwise(1_000_000), F.when(by_mode > 0, by_mode).otherwise(9), "profile_id")
    return suits.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")
