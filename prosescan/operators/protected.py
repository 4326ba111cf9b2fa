"""Protected content: what a rewrite must keep, and whether it did.

Each kind is extracted from the text with code and links blanked out, but for the kinds that are
code or links; items are counted per kind and value in the order in which they are first seen.

Defined results: null text has no items; without items the preservation score is null (unmeasured).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosescan.functions import text as T
from prosescan.functions.numbers import clamp_score

L, R = T.LEFT, T.RIGHT
# Pattern, exactness and what is cut off each kind of item.
FILE_ENDINGS = "md|markdown|ts|tsx|js|mjs|cjs|jsx|json|jsonl|toml|ya?ml|py|rs|go|java|rb|sh|bash|zsh|ps1|bat|cmd|txt|csv|tsv|html?|css|scss|less|sql|lock|cfg|ini|conf|env|xml|svg|png|jpe?g|gif|pdf"
CODE_BLOCK, INLINE_CODE, URL = r"(?s)```.*?```", r"`[^`\n]+`", r"""https?://[^\s<>()"'`。，）]+"""
KINDS = [
    ("code-block", CODE_BLOCK, True, ""),
    ("inline-code", INLINE_CODE, True, "^`|`$"),
    ("url", URL, True, ""),
    ("citation", r"(?i)(?:doi:\s*10\.\d{4,9}/\S+|arXiv:\s*\d{4}\.\d{4,5}|\[\d{1,3}\])", True, ""),
    ("date", rf"{L}\d{{4}}-\d{{2}}-\d{{2}}(?:[T ]\d{{2}}:\d{{2}}(?::\d{{2}})?Z?)?{R}", True, ""),
    ("path", rf"""(?i)(?:[A-Za-z]:\\[^\s"'<>|*?\n]+|(?:\.{{0,2}}/)?(?:[A-Za-z0-9_.@-]+/)+[A-Za-z0-9_.@-]+\.[A-Za-z0-9]{{1,8}}|{L}[A-Za-z0-9_@-]+\.(?:{FILE_ENDINGS}){R})""", True, ""),
    ("identifier", rf"{L}(?=[0-9a-f]{{7,64}}{R})(?=[0-9a-f]*\d)(?=[0-9a-f]*[a-f])[0-9a-f]+{R}", True, ""),
    ("quotation", r'(?:“[^”\n]{2,200}”|「[^」\n]{2,200}」|"[^"\n]{2,200}")', False, '^[“「"]|[”」"]$'),
    ("proper-noun", rf"(?:{L}[A-Z][a-zA-Z0-9]*(?:[ \t]+(?:(?:of|the|and|for|de|van|von)[ \t]+)?[A-Z][a-zA-Z0-9]*){{1,5}}|《[^》\n]{{1,60}}》)", True, ""),
    ("identifier", r"(?<![A-Za-z0-9_$])(?:[A-Za-z_$][A-Za-z0-9_$]*(?:\.[A-Za-z_$][A-Za-z0-9_$]*)+|[a-z][a-z0-9]*(?:_[a-z0-9]+)+|[A-Za-z][a-z0-9]*(?:[A-Z][a-z0-9]+)+|[A-Z]{2,}_[A-Z0-9_]+)", True, ""),
    ("number", rf"(?<![A-Za-z0-9_.])v?\d+(?:[.,]\d+)*(?:\s?%|\s?(?:ms|s|kg|km|MB|GB|KB|px|em|rem))?{R}", True, "^[vV]"),
]
NOISE = ("0", "1", "2")
STARTERS = (
    "a an the this that these those it its in on at by for from with without to of and but or nor if as so than then when while after before because since although though "
    "however therefore thus meanwhile there here we you they he she i my our your their his her is are was were be been being do does did not no yes all any some each every both few "
    "more most other such only own same also just can will would should could may might must run use see note given consider please once"
)


def masked(text: Column) -> Column:
    """Text with code and links replaced by as many spaces."""
    for pattern in (CODE_BLOCK, INLINE_CODE, URL):
        found, gaps = T.extract(text, pattern), F.split(text, pattern)
        spaces = F.transform(found, lambda m: F.repeat(F.lit(" "), F.char_length(m)))
        text = F.when(F.size(found) == 0, text).otherwise(F.array_join(F.flatten(F.transform(F.arrays_zip(gaps.alias("g"), spaces.alias("s")), lambda x: F.array(x["g"], F.coalesce(x["s"], F.lit(""))))), ""))
    return text


def is_heading(line: Column) -> Column:
    """Whether a line is a heading: marked so, or two to six capitalised words without a closing mark."""
    line = T.trim_all(line)
    ws = T.words(line)
    titled = F.forall(ws, lambda w: w.rlike(r"^(?:[A-Z][a-zA-Z0-9'’-]*|of|the|and|for|de|van|von)\z"))
    return line.rlike(r"^#{1,6}\s") | (F.size(ws).between(2, 6) & ~line.rlike(r"[.,;:!?—。，！？]\z") & titled)


def _proper(match: Column) -> Column:
    """A proper noun without a word that only opened the sentence; empty if fewer than two words are left."""
    ws = T.words(match)
    cut = F.when((F.size(ws) >= 2) & F.lower(F.try_element_at(ws, F.lit(1))).isin(*STARTERS.split()), F.slice(ws, 2, 64)).otherwise(ws)
    return F.when(match.startswith("《"), match).when(F.size(cut) >= 2, F.array_join(cut, " ")).otherwise("")


def items(text: Column, masked_text: Column) -> Column:
    """array<struct<kind,value,exact,occurrences,ord>>: every item of a text once, with the number of times it occurs.

    Equal items are neighbours once sorted, so each is a run between two starts and nothing is grouped across rows.
    """
    kinds = []
    for i, (kind, pattern, exact, cut) in enumerate(KINDS):
        where = text if i < 3 else masked_text
        if kind == "proper-noun":
            lines = F.filter(F.split(where, "\n"), lambda x: ~is_heading(x))
            values = F.transform(F.flatten(F.transform(lines, lambda x: T.extract(x, PROPER))), _proper)
        else:
            values = T.extract(where, pattern)
            values = F.transform(values, _cut(cut)) if cut else values
        values = F.filter(F.transform(values, T.trim_all), lambda v: v != "")
        if kind == "number":
            values = F.filter(values, lambda v: ~v.isin(*NOISE))
        kinds.append(F.transform(values, _item(i, kind, exact)))

    def runs(s: Column, starts: Column) -> Column:
        def one(at: Column, i: Column) -> Column:
            x = F.get(s, at)
            n = F.coalesce(F.get(starts, i + 1), F.size(s)) - at
            return F.struct(x["kind"].alias("kind"), x["value"].alias("value"), x["exact"].alias("exact"), n.alias("occurrences"), F.struct(x["k"].alias("k"), x["pos"].alias("pos")).alias("ord"))

        return F.transform(starts, one)

    def grouped(s: Column) -> Column:
        differs = lambda i: (i == 0) | (F.get(s, i)["kind"] != F.get(s, i - 1)["kind"]) | (F.get(s, i)["value"] != F.get(s, i - 1)["value"])
        every = F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1)).otherwise(F.array().cast("array<int>"))
        return T.let(F.filter(every, differs), lambda starts: runs(s, starts))

    return T.let(F.array_sort(F.flatten(F.array(*kinds))), grouped)


def _item(k: int, kind: str, exact: bool):
    return lambda v, i: F.struct(F.lit(kind).alias("kind"), v.alias("value"), F.lit(k).alias("k"), i.alias("pos"), F.lit(exact).alias("exact"))


def protected_items(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, kind, value, exact, occurrences, ord) of every item to keep."""
    body = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("masked", masked(F.col("text")))
    return body.select("doc_id", F.inline(items(F.col("text"), F.col("masked"))))


PROPER = next(p for k, p, _, _ in KINDS if k == "proper-noun")


def _cut(pattern: str):
    return lambda v: F.regexp_replace(v, pattern, "")


def loose(text: Column) -> Column:
    """Text with quotes unified, double and single ones apart, and white space collapsed; case counts."""
    plain = F.regexp_replace(F.regexp_replace(text, "[“”「」]", '"'), "[‘’『』]", "'")
    return T.trim_all(F.regexp_replace(plain, rf"[{T.SPACE}]+", " "))


def preservation(items: DataFrame, rewrites: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, kind, value, occurrences, found, state, severity): 'kept', 'altered' or 'lost' for every item of a rewritten document, and how grave that is (null if kept)."""
    new = rewrites.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("rewritten"))
    new = new.select("doc_id", "rewritten", loose(F.col("rewritten")).alias("flat"))
    both = items.join(new, "doc_id")
    own = loose(F.col("value"))
    found = F.when(F.col("exact"), T.literal_count(F.col("rewritten"), F.col("value"))).otherwise(T.literal_count(F.col("flat"), own))
    both = both.withColumn("found", found)
    nearly = F.col("exact") & F.contains(F.col("flat"), own)
    state = F.when(F.col("found") == 0, F.when(nearly, "altered").otherwise("lost")).when(F.col("found") < F.col("occurrences"), "altered").otherwise("kept")
    named = F.col("kind").isin("identifier", "number")
    gone = F.when(~F.col("exact"), 3).when(named, 5).otherwise(4)
    severity = F.when(F.col("found") == 0, gone).when(F.col("found") < F.col("occurrences"), F.when(F.col("kind") == "identifier", 4).otherwise(2))
    return both.select("doc_id", "kind", "value", "occurrences", "found", state.alias("state"), severity.alias("severity"))


def score_aggregates() -> list[Column]:
    """Aggregates of a document's states."""
    n = lambda s: F.count_if(F.col("state") == s)
    score = clamp_score(n("kept") / F.count("*") - 0.05 * n("altered") / F.count("*"))
    return [F.count("*").alias("n_items"), n("kept").alias("kept"), n("altered").alias("altered"), n("lost").alias("lost"), score.alias("preservation_score")]


def preservation_scores(states: DataFrame) -> DataFrame:
    """(doc_id, n_items, kept, altered, lost, preservation_score) of documents that have items."""
    return states.groupBy("doc_id").agg(*score_aggregates())
