"""Detectors: one struct expression each, over a table of prepared texts.

``prepared`` computes sentences, tokens and language once; ``findings`` selects the detectors that
run, explodes those that fired and gives one row per document, detector and rule. Nothing
shuffles: a detector whose family or rule is switched off never enters the plan.

Defined results: null text has no findings; an unknown rule makes its detector silent.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosescan.functions import text as T
from prosescan.plans import lexicon, patterns
from prosescan.sources.tables import spread

# Patterns and limits of the detectors.
BOLD = r"\*\*[^*\n]+\*\*"
HEADING = r"(?md)^#{1,6}[ \t]+(.+)$"
LIST_ITEM = r"(?md)^\s*(?:[-*+]|\d+\.)\s+"
DASH = "—|–|--|－"
# A chain of clauses up to a line's end. It can only begin where a sentence does, and only in one that the line's end closes; saying
# so first keeps the search from trying every way to part a long sentence.
SPLICE = r"(?md)(?<![^.;!?\n])(?=[^.;!?\n]*$)[^.;!?\n]{25,},\s+[^.;!?\n]{10,}?\s+[^.;!?\n]{10,}?\s+[^.;!?\n]{10,}$"
TRIAD = rf"(?i){T.LEFT}[A-Za-z0-9_'-]+(?:\s+[A-Za-z0-9_'-]+){{0,2}},\s+[A-Za-z0-9_'-]+(?:\s+[A-Za-z0-9_'-]+){{0,2}},\s+and\s+[A-Za-z0-9_'-]+(?:\s+[A-Za-z0-9_'-]+){{0,2}}{T.RIGHT}"
MARKED_OPENING = r"^(?:[-*+•·]|\d+[.)]|#{1,6}\s|\*\*|__|>\s)"
PASSIVE = (
    rf"(?i){T.LEFT}(?:is|are|was|were|be|been|being|am)\s+(?:[A-Za-z0-9_]+ed|known|made|given|taken|seen|done|shown|found|held|kept|left|met|paid|put|read|run|said|sold|sent|set"
    rf"|told|thought|understood|written|built|chosen|driven|felt|grown|lost|meant){T.RIGHT}"
)
SUBJECTLESS = rf"(?i)(?:\A|[.!?]\s+)No\s+[A-Za-z0-9_]+\s+(?:is|are|was|were)\s+[A-Za-z0-9_]+ed{T.RIGHT}"
HAN = r"\x{4E00}-\x{9FFF}"
HALF_STOP = rf"[{HAN}][.!?](?![0-9])|(?<![0-9])[.!?][{HAN}]"
HALF_COMMA = rf"[{HAN}],|,[{HAN}]"
ANCHORS = {"ttr": 0.7, "cv": 0.5, "hapax": 0.6, "width": 0.3, "neutral": 0.5}

FINDING = "rule_id string, detector_id string, family string, severity int, confidence double, evidence array<struct<start:int,end:int,text:string>>"


def prepared(docs: DataFrame, doc_id: str, text: str, *keep: str) -> DataFrame:
    """(doc_id, text, kept columns) and, computed once per text: language, lower, sentences, tokens, words, and the
    moments of sentence lengths in tokens (rhythm) and in words (spaced).
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = spread(docs.select(F.col(doc_id).alias("doc_id"), body.alias("text"), *keep))
    t = F.col("text")
    rows = rows.select("*", T.language(t).alias("language"), F.lower(t).alias("lower"), T.sentences(t).alias("sentences"), T.tokens(t).alias("tokens"), T.words(t).alias("words"))
    lengths = F.transform("sentences", lambda s: F.size(T.tokens(s)).cast("double"))
    spaced = F.transform(T.spaced_sentences(t), lambda s: F.size(T.words(s)).cast("double"))
    return rows.select("*", T.moments(lengths).alias("rhythm"), T.moments(spaced).alias("spaced"), F.array_sort(F.transform("words", F.lower)).alias("sorted_words"))


def lexical_features(text: Column) -> dict[str, Column]:
    """Type-token ratio, variation of sentence length, share of words used once; null below two sentences. For a prepared row."""
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("kinds"), F.lit(0).alias("once"))

    def step(a: Column, w: Column) -> Column:
        same = F.coalesce(a["last"] == w, F.lit(False))
        return F.struct(w.alias("last"), F.when(same, a["run"] + 1).otherwise(1).alias("run"), F.when(same, a["kinds"]).otherwise(a["kinds"] + 1).alias("kinds"), F.when(same, F.when(a["run"] == 1, a["once"] - 1).otherwise(a["once"])).otherwise(a["once"] + 1).alias("once"))

    # equal words are neighbours in sorted order, so one fold counts kinds and those used once
    folded = F.aggregate("sorted_words", start, step)
    enough = (F.col("spaced.n") >= 2) & (F.size("words") > 0)
    return {
        "ttr": F.when(enough, folded["kinds"] / F.size("words")),
        "cv": F.when(enough, T.variation(F.col("spaced"))),
        "hapax": F.when(enough, F.try_divide(folded["once"], folded["kinds"])),
        "n_types": folded["kinds"],
    }


def anchor_score(value: Column, name: str) -> Column:
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.lit(ANCHORS[name]) - value) / F.lit(ANCHORS["width"]))))


def statistical_score(ttr: Column, cv: Column, hapax: Column) -> Column:
    """Mean distance from the anchors, neutral where the text was too short."""
    return F.coalesce((anchor_score(ttr, "ttr") + anchor_score(cv, "cv") + anchor_score(hapax, "hapax")) / 3, F.lit(ANCHORS["neutral"]))


def opening(sentence: Column) -> Column:
    """First word of a sentence, or its first two characters."""
    bare = T.trim_all(sentence)
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(bare, "^([A-Za-z']+)", 1)), F.lit("")), F.substring(bare, 1, 2))


def prose_sentences(sentences: Column) -> Column:
    """Sentences that have a word and don't open with markup."""
    return F.filter(sentences, lambda s: ~T.trim_all(s).rlike(MARKED_OPENING) & s.rlike(r"[\p{IsHan}A-Za-z0-9]"))


def longest_run(items: Column) -> Column:
    """Length of the longest run of equal neighbours."""
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(a: Column, x: Column) -> Column:
        run = F.when(a["last"] == x, a["run"] + 1).otherwise(1)
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(a["best"], run).alias("best"))

    return F.aggregate(items, start, step)["best"]


def first_run(items: Column, least: int) -> Column:
    """struct<at, n> of the first run of at least ``least`` equal neighbours, at its whole length; n is 0 if there is none."""
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("i"), F.lit(0).alias("at"), F.lit(0).alias("n"), F.lit(False).alias("over"))

    def step(a: Column, x: Column) -> Column:
        same = F.coalesce(a["last"] == x, F.lit(False))
        run = F.when(same, a["run"] + 1).otherwise(1)
        found = ~a["over"] & (run >= least)
        return F.struct(x.alias("last"), run.alias("run"), (a["i"] + 1).alias("i"), F.when(found, a["i"] + 1 - run).otherwise(a["at"]).alias("at"), F.when(found, run).otherwise(a["n"]).alias("n"), (a["over"] | ((a["n"] > 0) & ~same)).alias("over"))

    return F.aggregate(items, start, step)


def title_case(heading: Column) -> Column:
    """Whether a heading of three words or more is capitalised nearly throughout."""
    alpha = F.filter(T.words(heading), lambda w: w.rlike("[A-Za-z]"))
    return (F.size(alpha) >= 3) & (F.try_divide(F.size(F.filter(alpha, lambda w: w.rlike("^[A-Z]"))), F.size(alpha)) >= 0.8)


def restated_headings(text: Column) -> Column:
    """Spans of headings whose words come back in the first sentence below, up to three.

    Below a heading stands the first block with words that doesn't open with a number sign; a heading's own block counts
    for it, but not for a heading above it. One fold from the end carries the block that headings above would see.
    """
    pieces = F.split(text, r"(?md)^(?=#{1,6}[ \t]+.)")

    def parts(piece: Column) -> Column:
        body = F.regexp_replace(piece, r"\A#{1,6}[ \t]+[^\n]+", "")
        blocks = F.split(body, r"\n\s*\n")
        kept = lambda bs: F.get(F.filter(F.transform(bs, T.trim_all), lambda b: (b != "") & ~b.startswith("#")), 0)
        return F.struct(F.regexp_extract(piece, r"\A#{1,6}[ \t]+([^\n]+)", 1).alias("head"), F.char_length(piece).alias("size"), kept(blocks).alias("own"), kept(F.slice(blocks, 2, 1_000_000)).alias("under"))

    spots = F.array().cast("array<struct<start:int,head:string,below:string>>")
    start = F.struct(F.char_length(text).alias("at"), F.lit(None).cast("string").alias("below"), spots.alias("out"))

    def step(a: Column, x: Column) -> Column:
        at = a["at"] - x["size"]
        seen = F.array_append(a["out"], F.struct(at.alias("start"), x["head"].alias("head"), F.coalesce(x["own"], a["below"]).alias("below")))
        return F.struct(at.alias("at"), F.coalesce(x["under"], a["below"]).alias("below"), seen.alias("out"))

    folded = F.aggregate(F.reverse(F.transform(pieces, parts)), start, step)["out"]

    def found(x: Column) -> Column:
        first = F.get(T.sentences(x["below"]), 0)
        keys = F.array_distinct(F.filter(T.words(F.lower(x["head"])), lambda w: F.char_length(w) > 3))

        def judged(k: Column) -> Column:
            shared = F.size(F.filter(F.transform(T.words(F.lower(first)), lambda w: F.regexp_replace(w, "[^a-z]", "")), lambda w: F.array_contains(k, w)))
            return (x["head"] != "") & (F.size(k) > 0) & first.isNotNull() & (shared >= F.greatest(F.lit(2), F.ceil(F.size(k) * 0.7)))

        whole = F.concat(T.trim_all(x["head"]), F.lit(" / "), F.substring(first, 1, 60))
        return F.when(T.let(keys, judged), F.struct(x["start"].alias("start"), (x["start"] + F.char_length(whole)).alias("end"), whole.alias("text")))

    return F.slice(F.filter(F.transform(F.reverse(folded), found), lambda x: x.isNotNull()), 1, 3)


def one_line_closers(text: Column) -> Column:
    """Short single-sentence paragraphs right after long ones, up to three."""
    none = F.array().cast("array<string>")
    start = F.struct(F.lit(0).alias("before"), none.alias("out"))

    def step(a: Column, p: Column) -> Column:
        size = F.size(T.words(p))
        closes = (F.size(a["out"]) < 3) & (a["before"] >= 40) & (size <= 12) & (F.size(T.sentences(p)) == 1)
        return F.struct(size.alias("before"), F.when(closes, F.array_append(a["out"], p)).otherwise(a["out"]).alias("out"))

    return F.aggregate(T.paragraphs(text), start, step)["out"]


def translationese(text: Column) -> dict[str, Column]:
    """Counts of the signals of translated Chinese, and how many besides the anchor are over their limit."""
    n = {k: T.count(text, p) for k, p in (("passive", "被"), ("light_verb", "进行|作出|加以|予以"), ("abstract", rf"[{HAN}][性化度]"), ("pronoun", "它们|它|他们|她们"))}
    over = sum(F.when(n[k] >= limit, 1).otherwise(0) for k, limit in (("passive", 2), ("light_verb", 3), ("abstract", 6), ("pronoun", 6)))
    cjk = T.cjk_count(text)
    return {"n_cjk": cjk, "de_density": F.coalesce(F.try_divide(T.count(text, "的") * F.lit(100.0), cjk), F.lit(0.0)), **n, "corroborating": over}


def _nothing() -> Column:
    return F.array().cast("array<struct<start:int,end:int,text:string>>")


def _made(rule: str, detector: str, family: str, fired: Column, confidence: Column | float, evidence: Column | None = None) -> Column | None:
    """Finding of a detector where it fired, else null; None if no rule of that name is published."""
    severity = lexicon.severity(rule)
    if severity is None:
        return None
    confidence = F.lit(confidence) if isinstance(confidence, float) else confidence
    shape = F.struct(F.lit(rule).alias("rule_id"), F.lit(detector).alias("detector_id"), F.lit(family).alias("family"), F.lit(severity).alias("severity"), confidence.cast("double").alias("confidence"), (_nothing() if evidence is None else evidence).alias("evidence"))
    return F.when(fired, shape)


def _let(value: Column, made: Callable[[Column], Column | None]) -> Column:
    """``made`` of a value that is computed once; null if no such rule is published."""
    return T.let(value, lambda x: F.lit(None) if (f := made(x)) is None else f)


def watched(kinds: Iterable[str] = ("literal", "template"), more: Iterable[patterns.Pattern] = ()) -> Column:
    """The watched phrases, and more of them, as one constant array, so that a plan's size doesn't grow with them."""
    langs = {r["rule_id"]: r["languages"] for r in lexicon.rules()}
    families = {"formatting": "structural", "chat": "assistant"}
    rows = []
    for p in [*patterns.compiled()[0], *more]:
        if p.kind in kinds:
            category = p.rule_id.split(".")[0]
            literal = p.kind == "literal"
            rows.append({
                "rule_id": p.rule_id, "phrase": p.phrase, "detector_id": "lexical.watched_phrases" if literal else "structural.templates", "family": "lexical" if literal else families.get(category, category),
                "severity": lexicon.severity(p.rule_id), "confidence": p.confidence, "languages": langs.get(p.rule_id, ["en", "zh"]), "needles": list(p.needles), "pattern": p.pattern,
            })
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<rule_id:string,phrase:string,detector_id:string,family:string,severity:int,confidence:double,languages:array<string>,needles:array<string>,pattern:string>>")


def present(phrases: Column) -> Column:
    """The phrases that can match a prepared text at all, by plain search in its lower-case form: it spares nearly all regular expressions."""
    return F.filter(phrases, lambda p: (F.size(p["needles"]) == 0) | F.exists(p["needles"], lambda n: F.contains(F.col("lower"), n)))


def phrase_counts(docs: DataFrame, kinds: Iterable[str], more: Iterable[patterns.Pattern] = ()) -> DataFrame:
    """(doc_id, rule_id, phrase, n) of every watched phrase in every prepared text that has it, whatever its language."""
    found = F.transform(present(watched(kinds, more)), lambda p: F.struct(p["rule_id"].alias("rule_id"), p["phrase"].alias("phrase"), T.count(F.col("text"), p["pattern"]).alias("n")))
    return docs.select("doc_id", F.inline(F.filter(found, lambda x: x["n"] > 0)))


def phrase_matches(text: Column) -> Column:
    """Matches of the phrases that apply to the text's language, up to five spans of each."""
    apply = F.filter(present(watched()), lambda p: F.array_contains(p["languages"], F.col("language")) | (F.col("language") == "unknown"))
    shown = ("rule_id", "detector_id", "family", "severity", "confidence")
    found = F.transform(apply, lambda p: F.struct(*[p[c].alias(c) for c in shown], T.spans(text, p["pattern"], 5).alias("evidence")))
    return F.filter(found, lambda x: F.size(x["evidence"]) > 0)


def lexical_detectors(text: Column) -> Column:
    """Watched phrases and templates: one finding per rule and detector, as sure as its surest match. For a row that has ``matches``."""
    matches = F.col("matches")
    rules = F.array_distinct(F.transform(matches, lambda m: F.struct(m["rule_id"].alias("rule_id"), m["detector_id"].alias("detector_id"), m["family"].alias("family"), m["severity"].alias("severity"))))

    def merged(r: Column) -> Column:
        own = F.filter(matches, lambda m: (m["rule_id"] == r["rule_id"]) & (m["detector_id"] == r["detector_id"]))
        evidence = F.slice(F.flatten(F.transform(own, lambda m: m["evidence"])), 1, 5)
        return F.struct(*[r[c].alias(c) for c in ("rule_id", "detector_id", "family", "severity")], F.array_max(F.transform(own, lambda m: m["confidence"])).alias("confidence"), evidence.alias("evidence"))

    return F.transform(rules, merged)


def structural_detectors(text: Column) -> list[Column]:
    """Bold, headings, structure, restated headings and closers."""
    size = F.greatest(F.lit(1), F.char_length(text))
    bolds, heads = T.extract(text, BOLD), F.transform(T.extract(text, HEADING, 1), T.trim_all)
    titles, decorated = F.filter(heads, title_case), F.filter(heads, lambda h: h.rlike(T.DECORATION))
    marks = F.size(heads) + T.count(text, LIST_ITEM)
    d, f = "structural.document_shape", "structural"
    return [
        _made("formatting.bold_decoration", d, f, (F.size(bolds) >= 3) & (T.per_thousand(F.size(bolds), size) >= 12), 0.7, T.first_seen(text, bolds, 5, 60)),
        _made("formatting.decorative_headings", d, f, (F.size(heads) >= 2) & (F.size(titles) >= 2) & (F.try_divide(F.size(titles), F.size(heads)) >= 0.6), 0.7, T.first_seen(text, titles, 4, 200)),
        _made("formatting.decorative_headings", d, f, (F.size(heads) >= 2) & (F.size(decorated) >= 2), 0.8, T.first_seen(text, decorated, 4, 200)),
        _made("formatting.excessive_structure", d, f, (marks >= 6) & (T.per_thousand(marks, size) >= 20), 0.65),
        _let(restated_headings(text), lambda spans: _made("structural.heading_restated", d, f, F.size(spans) > 0, 0.6, spans)),
        _let(one_line_closers(text), lambda closers: _made("structural.one_line_closer", d, f, F.size(closers) >= 2, 0.6, T.first_seen(text, closers, 3, 80))),
    ]


def rhythm_detectors(text: Column) -> list[Column]:
    """Uniform rhythm, dashes, repeated openings, comma splices, triads."""
    burst = T.variation(F.col("rhythm"))
    dashes, size = T.count(text, DASH), F.char_length(text)
    d, f = "rhythm.distribution", "rhythm"
    prose = prose_sentences(F.col("sentences"))
    # evidence goes by the kind of dash first, as far as five of them
    marks = F.flatten(F.array(*[T.spans(text, kind, 5) for kind in DASH.split("|")]))
    repeated = lambda x: F.struct(x.alias("prose"), first_run(F.transform(x, opening), 3).alias("run"))
    splices, triads = T.extract(text, SPLICE), T.extract(text, TRIAD)
    return [
        _made("rhythm.uniform_rhythm", d, f, (F.size("sentences") >= 5) & (burst < 0.35), 0.75, T.first_seen(text, F.col("sentences"), 3, 80)),
        _made("rhythm.dash_overuse", d, f, (dashes >= 3) & (T.per_thousand(dashes, size) >= 6), 0.8, F.slice(marks, 1, 5)),
        _let(T.let(prose, repeated), lambda r: _made("rhythm.repeated_openings", d, f, r["run"]["n"] >= 3, 0.85, T.first_seen(text, F.slice(r["prose"], r["run"]["at"] + 1, r["run"]["n"]), None, 60))),
        _made("rhythm.comma_splice_rhythm", d, f, (F.col("language") != "zh") & (F.size(splices) >= 2), 0.5, T.first_seen(text, splices, 3, 80)),
        _made("rhythm.forced_triad", d, f, F.size(triads) >= 3, 0.6, T.first_seen(text, triads, 4, 70)),
    ]


def chinese_detectors(text: Column) -> list[Column]:
    """Mixed punctuation widths, long dashes and translated Chinese."""
    zh = F.col("language") == "zh"
    typed = zh & (T.cjk_count(text) >= 80)
    s = translationese(text)
    pairs = lambda full, half: (T.count(text, full) >= 2) & (T.count(text, half) >= 2)
    return [
        _made("chinese.punctuation_width", "chinese.typography", "chinese", typed & pairs("[。！？]", HALF_STOP), 0.8, T.spans(text, HALF_STOP, 5)),
        _made("rhythm.dash_overuse", "chinese.typography", "chinese", typed & (T.count(text, "——|—") >= 2), 0.7, T.spans(text, "——|—", 5)),
        _made("chinese.punctuation_width", "chinese.typography", "chinese", typed & pairs("[，、]", HALF_COMMA), 0.65),
        _made("chinese.translationese", "chinese.translationese", "chinese", zh & (s["n_cjk"] >= 120) & (F.round(s["de_density"], 2) >= 8) & (s["corroborating"] >= 1), F.when(s["corroborating"] >= 2, 0.75).otherwise(0.6), T.spans(text, "的", 5)),
    ]


def english_detectors(text: Column) -> list[Column]:
    """Passive voice and dropped subjects."""
    n, passives = F.size("words"), T.count(text, PASSIVE)
    gate = (F.col("language") == "en") & (n >= 120)
    rule, d = "lexical.passive_and_subjectless", "english.construction"
    return [
        _made(rule, d, "english", gate & (passives >= 3) & (T.per_thousand(passives, n) >= 12), 0.6, T.spans(text, PASSIVE, 5)),
        _made(rule, d, "english", gate & (T.count(text, SUBJECTLESS) >= 2), 0.7, T.spans(text, SUBJECTLESS, 5)),
    ]


def stylometry_detectors(text: Column) -> list[Column]:
    """Low lexical diversity and uniform sentence length by their anchors."""
    x = lexical_features(text)
    en = F.col("language") == "en"
    diversity = (anchor_score(x["ttr"], "ttr") + anchor_score(x["hapax"], "hapax")) / 2
    enough = en & (F.size("words") >= 150) & (x["n_types"] >= 40)
    return [
        _made("lexical.low_lexical_diversity", "stylometry.statistical", "stylometry", enough & (diversity >= 0.5), 0.45),
        _made("rhythm.uniform_rhythm", "stylometry.statistical", "stylometry", enough & (anchor_score(x["cv"], "cv") >= 0.6), 0.45),
    ]


#: Detectors in the order in which a cap on raw findings counts them, by the families that they may report.
DETECTORS: list[tuple[set[str], Callable[[Column], Column | list[Column]]]] = [
    ({"lexical", "structural", "rhythm", "assistant", "chinese"}, lexical_detectors),
    ({"structural"}, structural_detectors),
    ({"rhythm"}, rhythm_detectors),
    ({"chinese"}, chinese_detectors),
    ({"english"}, english_detectors),
    ({"stylometry"}, stylometry_detectors),
]


def with_findings(docs: DataFrame, families: Iterable[str] | None = None, most: int = 500, only: Iterable[Callable[[Column], Column | list[Column]]] | None = None) -> DataFrame:
    """Prepared texts with their raw findings as one array ``found``; a column ``more`` of findings made elsewhere comes last.

    At most ``most`` findings of a text are kept, in the order of the detectors; ``only`` names the detectors that run.
    """
    chosen = None if families is None else set(families)
    run = [f for own, f in DETECTORS if (chosen is None or own & chosen) and (only is None or f in only)]
    text = F.col("text")
    if lexical_detectors in run:
        docs = docs.withColumn("matches", phrase_matches(text))
    parts = [lexical_detectors(text) if f is lexical_detectors else F.array(*[x for x in f(text) if x is not None]) for f in run]
    parts.append(F.col("more") if "more" in docs.columns else F.array().cast(f"array<struct<{_typed(FINDING)}>>"))
    kept = F.filter(F.concat(*parts), lambda x: x.isNotNull() if chosen is None else x.isNotNull() & x["family"].isin(*sorted(chosen)))
    return docs.withColumn("found", F.slice(kept, 1, most)).drop("matches", "more")


def _typed(columns: str) -> str:
    return re.sub(r"(^|, )(\w+) ", r"\1\2:", columns).replace(", ", ",")


def findings(docs: DataFrame, families: Iterable[str] | None = None, most: int = 500, only: Iterable[Callable[[Column], Column | list[Column]]] | None = None) -> DataFrame:
    """Raw findings (doc_id, ord, rule_id, detector_id, family, severity, confidence, evidence) of prepared texts, as rows."""
    rows = with_findings(docs, families, most, only).select("doc_id", F.posexplode(T.each("found")).alias("ord", "f"))
    return rows.select("doc_id", "ord", "f.*")
