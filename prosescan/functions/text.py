"""Text primitives as column functions.

Offsets are code points from 0. All patterns are written so that Java's regular expressions give
the same matches as an engine with ASCII word borders and Unicode white space.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes.
#: Matches that one fold of all spans appends.
SPAN_BLOCK = 500
SPACE = r"\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
CJK = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}"
TERMINATORS = r".!?\n。！？；…"
CJK_PUNCTUATION = "。，！？；：、“”‘’「」『』…—"
#: Borders of a word of ASCII letters, digits and underscores.
LEFT, RIGHT = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
#: Text in which messages are kept apart.
MESSAGE_SEPARATOR = "<!-- msg -->"
# Emoji ranges.
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}\x{1F1E6}-\x{1F1FF}]"
DECORATION = r"[\x{1F300}-\x{1FAFF}\x{2190}-\x{21FF}\x{2600}-\x{27BF}]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often and within whichever lambda it is used."""
    return F.transform(F.array(value), use)[0]


def each(array: Column | str) -> Column:
    """An array of structs to explode. Exploding a bare column makes the optimizer push its size as a filter below all that computes it, which then runs again for every condition."""
    return F.filter(array, lambda x: x.isNotNull())


def count(text: Column, pattern: str | Column) -> Column:
    """Number of matches of a pattern; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))


def extract(text: Column, pattern: str | Column, group: int = 0) -> Column:
    """All matches of a pattern, or of one of its groups; empty for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.array().cast("array<string>"))


def trim_all(text: Column) -> Column:
    """Text without white space of any script at its ends."""
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def cjk_count(text: Column) -> Column:
    return count(text, f"[{CJK}]")


def latin_count(text: Column) -> Column:
    return count(text, "[A-Za-z]")


def language(text: Column) -> Column:
    """'zh' or 'en' by the share of CJK characters among CJK and ASCII letters, else 'unknown'."""
    cjk, latin = cjk_count(text), latin_count(text)
    share = F.try_divide(cjk, cjk + latin)
    return F.when(share >= 0.5, "zh").when(share <= 0.05, "en").otherwise("unknown")


def mostly_cjk(text: Column, share: float) -> Column:
    """Whether code points from U+3000 on make up ``share`` of those that aren't white space."""
    ink = count(text, rf"[^{SPACE}]")
    return F.coalesce(F.try_divide(count(text, r"[^\x{0000}-\x{2FFF}]") - count(text, r"[\x{3000}\x{FEFF}]"), ink) >= share, F.lit(False))


def sentences(text: Column) -> Column:
    """Sentences, each with its terminator; every terminator ends one."""
    parts = extract(text, f"[^{TERMINATORS}]*[{TERMINATORS}]|[^{TERMINATORS}]+")
    return F.filter(F.transform(parts, trim_all), lambda s: s != "")


def spaced_sentences(text: Column) -> Column:
    """Sentences split only at white space after a full stop, exclamation or question mark."""
    return F.filter(F.transform(F.split(text, rf"(?<=[.!?])[{SPACE}]+"), trim_all), lambda s: s != "")


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters, digits and apostrophes, and single CJK characters."""
    return F.transform(extract(text, f"[A-Za-z0-9']+|[{CJK}]"), F.lower)


def words(text: Column) -> Column:
    """Runs of characters that aren't white space."""
    return extract(text, rf"[^{SPACE}]+")


def paragraphs(text: Column) -> Column:
    """Blocks between empty lines, without blank ones and headings."""
    return F.filter(F.transform(F.split(text, r"\n{2,}"), trim_all), lambda p: (p != "") & ~p.startswith("#"))


def messages(text: Column) -> Column:
    """Messages of a chat sample."""
    return F.filter(F.transform(F.split(text, MESSAGE_SEPARATOR), trim_all), lambda m: m != "")


def normalized(text: Column) -> Column:
    """Quotes unified and white space collapsed."""
    plain = F.regexp_replace(F.regexp_replace(text, "[“”「」『』]", '"'), "[‘’]", "'")
    return trim_all(F.regexp_replace(plain, rf"[{SPACE}]+", " "))


def phrase_key(text: Column) -> Column:
    """Key under which spellings of a phrase meet in any script: lower case, single spaces, no sentence punctuation, brackets or quotes at the ends."""
    flat = F.regexp_replace(F.lower(text), rf"[{SPACE}]+", " ")
    edge = r"""[ !?.,;:()\[\]"'“”。！？，、]+"""
    return F.regexp_replace(flat, rf"^{edge}|{edge}\z", "")


def literal_count(text: Column, needle: Column) -> Column:
    """Non-overlapping occurrences of a literal; 0 for an empty one."""
    size = F.char_length(needle)
    return F.when(size > 0, F.floor((F.char_length(text) - F.char_length(F.replace(text, needle, F.lit("")))) / size)).otherwise(0).cast("int")


def per_thousand(n: Column, of: Column) -> Column:
    return F.coalesce(F.try_divide(n * F.lit(1000.0), of), F.lit(0.0))


def spans(text: Column, pattern: str | Column, limit: int | None = 20) -> Column:
    """array<struct<start,end,text>> of the first matches, or of all for None. The pattern must not match the empty string.

    One fold over the matches and the gaps before them, so the text is searched twice however many matches it has.
    """
    pairs = F.arrays_zip(extract(text, pattern).alias("m"), F.split(text, pattern).alias("g"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,text:string>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        begin = a["at"] + F.char_length(x["g"])
        end = begin + F.char_length(x["m"])
        return F.struct(F.coalesce(end, a["at"]).alias("at"), F.when(x["m"].isNull(), a["out"]).otherwise(F.array_append(a["out"], F.struct(begin.alias("start"), end.alias("end"), x["m"].alias("text")))).alias("out"))

    if limit is not None:
        return F.aggregate(F.slice(pairs, 1, limit), start, step)["out"]
    # a fold of folds over blocks, as appending to one long array would copy it for every match; the outer transform evaluates the pairs once
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,end:int,text:string>>>").alias("out"))

    def block(a: Column, part: Column) -> Column:
        within = F.aggregate(part, F.struct(a["at"].alias("at"), F.array().cast("array<struct<start:int,end:int,text:string>>").alias("out")), step)
        return F.struct(within["at"].alias("at"), F.array_append(a["out"], within["out"]).alias("out"))

    parts = lambda p: F.transform(F.sequence(F.lit(0), F.floor(F.size(p) / SPAN_BLOCK).cast("int")), lambda k: F.slice(p, k * SPAN_BLOCK + 1, F.lit(SPAN_BLOCK)))
    return F.flatten(F.transform(F.array(pairs), lambda p: F.flatten(F.aggregate(parts(p), none, block)["out"])))


def first_seen(text: Column, found: Column, limit: int | None, shown: int) -> Column:
    """Spans of strings at their first occurrence in the text; of all of them for None."""
    return F.transform(found if limit is None else F.slice(found, 1, limit), lambda m: F.struct((F.instr(text, m) - 1).alias("start"), (F.instr(text, m) - 1 + F.char_length(m)).alias("end"), F.substring(m, 1, shown).alias("text")))


def moments(values: Column) -> Column:
    """struct<n, mean, m2> of an array of numbers in one stable pass."""
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def step(a: Column, x: Column) -> Column:
        n = a["n"] + 1
        mean = a["mean"] + (x - a["mean"]) / n
        return F.struct(n.alias("n"), mean.alias("mean"), (a["m2"] + (x - a["mean"]) * (x - mean)).alias("m2"))

    return F.aggregate(values, start, step)


def mean(m: Column) -> Column:
    """Mean from moments; null without values."""
    return F.when(m["n"] > 0, m["mean"])


def spread(m: Column) -> Column:
    """Population standard deviation from moments; null without values."""
    return F.when(m["n"] > 0, F.sqrt(m["m2"] / m["n"]))


def variation(m: Column) -> Column:
    """Standard deviation over mean, from moments; 0 where the mean is."""
    return F.coalesce(F.try_divide(spread(m), mean(m)), F.lit(0.0))


def median(values: Column) -> Column:
    """Median of an array of numbers; null for an empty one."""
    s, n = F.array_sort(values), F.size(values)
    at = lambda i: F.get(s, i.cast("int") - 1)
    return (at(F.floor((n + 1) / 2)) + at(F.floor((n + 2) / 2))) / F.lit(2.0)


def distribution(values: Column) -> Column:
    """struct<mean, median, std_dev, min, max, sample_count>, rounded to four places; zeros for no values."""
    some = lambda c: F.coalesce(F.round(c.cast("double"), 4), F.lit(0.0))
    m = moments(values)
    return F.struct(some(mean(m)).alias("mean"), some(median(values)).alias("median"), some(spread(m)).alias("std_dev"), some(F.array_min(values)).alias("min"), some(F.array_max(values)).alias("max"), F.size(values).alias("sample_count"))


def text_statistics(text: Column) -> dict[str, Column]:
    """Counts and sentence rhythm, for a row that has ``sentences``, ``tokens`` and ``rhythm`` (the moments of sentence lengths in tokens)."""
    return {
        "n_chars": F.char_length(text),
        "n_cjk": cjk_count(text),
        "n_latin": latin_count(text),
        "n_sentences": F.size("sentences"),
        "n_tokens": F.size("tokens"),
        "mean_length": F.coalesce(mean(F.col("rhythm")), F.lit(0.0)),
        "spread_length": F.coalesce(spread(F.col("rhythm")), F.lit(0.0)),
        "burstiness": variation(F.col("rhythm")),
    }
