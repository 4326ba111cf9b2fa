"""Text that looks the same brought to one form, so that comparisons work.

A text is normalised for compatibility, character by character and only where the result looks
alike (forms that look different, such as superscripts and circled digits, stay); ignorable
characters are deleted and spaces unified. Each letter that has look-alikes in other scripts then
opens a lattice of readings. A Viterbi search takes the path with the best sum of character
bigram scores, which are learnt from clean reference texts, of penalties for changes of script
within a word and of a small cost for every change; accents are put back on the letter chosen.

Defined results: null stays null, and empty stays empty; joiners inside emoji, and those that
Arabic and Indic scripts need, stay; a word whose letters are all of one script, unlike its
text's, is read in the text's script only if all its letters have a look-alike there.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from math import log

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosescan.functions.scratch import materialize, small_or_shuffled

# Letters and signs that look like the one before the colon.
LOOK_ALIKES = """
a: аɑα
b: Ƅ
c: сϲᴄⲥ
d: ԁ
e: еҽ
g: ɡց
h: һհ
i: іꙇ
j: јϳ
l: ӏ
n: ո
o: оοօᴏⲟ
p: рρⲣ
q: ԛզ
r: ᴦ
s: ѕꜱ
u: սυᴜ
v: ѵνᴠ
w: ԝѡᴡ
x: х
y: уүγ
z: ᴢ
A: АΑᎪ
B: ВΒᏴ
C: СϹᏟⲤ
D: Ꭰ
E: ЕΕᎬ
F: Ϝ
G: ԌᏀ
H: НΗᎻ
I: ІΙӀ
J: ЈͿᎫ
K: КΚᏦ
L: Ꮮ
M: МΜϺᎷ
N: ΝⲚ
O: ОΟՕⲞ
P: РΡⲢᏢ
Q: Ԛ
R: Ꭱ
S: ЅՏᏚ
T: ТΤᎢ
U: Ս
V: ѴᏙ
W: ԜᎳ
X: ХΧ
Y: ΥҮ
Z: ΖᏃ
Γ: Г
Π: П
Φ: Ф
κ: к
"""
SIGNS = {"‐": "-", "‑": "-", "․": ".", "∕": "/", "⁄": "/", "꞉": ":", "∶": ":", "ǃ": "!", "⼁": "丨"}
#: Compatibility forms that look different from what they stand for.
DIFFERENT = {"<super>", "<sub>", "<circle>", "<fraction>", "<square>", "<vertical>"}
IGNORABLE = regex.compile(r"[\p{Cf}\p{Default_Ignorable_Code_Point}--‌‍]", regex.V1)
JOINER = regex.compile(r"(?<![\p{Extended_Pictographic}\p{Arabic}\p{Devanagari}\p{Bengali}\p{Malayalam}\p{Sinhala}\p{Tamil}\p{Telugu}\p{Kannada}️\p{EMod}]\p{M}*)[‌‍]|[‌‍](?![\p{Extended_Pictographic}\p{L}--\p{Latin}])", regex.V1)
LETTERS = regex.compile(r"[[\p{L}\p{M}]--[\p{Han}\p{Hiragana}\p{Katakana}]]+", regex.V1)
CHANGE, SWITCH, UNKNOWN, FOREIGN = -1.0, -6.0, log(1 / 30), -6.0

READINGS: dict[str, str] = {}
for _line in LOOK_ALIKES.split("\n"):
    if _line:
        _class = _line[0] + _line[3:]
        READINGS |= {c: READINGS.get(c, "") + _class for c in _class}


@lru_cache(maxsize=100_000)
def script(char: str) -> str:
    """Script of a letter by the first word of its Unicode name; other characters have none."""
    if not char.isalpha():
        return ""
    first = unicodedata.name(char, "").split(" ")[0]
    # letters of phonetic alphabets are no letters of running Latin text
    return "PHONETIC" if first == "LATIN" and char in READINGS and not char.isascii() else first


@lru_cache(maxsize=100_000)
def _compatible(char: str) -> str:
    if char in SIGNS:
        return SIGNS[char]
    if char in READINGS:
        return char
    kind = unicodedata.decomposition(char).split(" ")[0]
    if kind in DIFFERENT:
        return char
    plain = unicodedata.normalize("NFKC", char)
    if unicodedata.category(plain[:1] or " ") == "Zs":
        return " "
    return "".join(SIGNS.get(c, c) for c in plain)


def compatible(text: str) -> str:
    """Compatibility form of a text without its ignorable characters."""
    if text.isascii():
        return text
    text = JOINER.sub("", IGNORABLE.sub("", text))
    return unicodedata.normalize("NFC", "".join(map(_compatible, text)))


class Reader:
    """Reads texts in their most plausible letters; ``bigrams`` has counts of lower-case letter pairs, ^ and $ being the borders of a word."""

    def __init__(self, bigrams: dict[str, int]):
        # scripts of which clean texts were seen; letters of others have no better guess than an even one
        self.known = {script(c) for pair in bigrams for c in pair if c not in "^$"}
        totals: dict[str, int] = {}
        for pair, n in bigrams.items():
            totals[pair[0]] = totals.get(pair[0], 0) + n
        self.scores = {pair: max(log((n + 0.5) / (totals[pair[0]] + 20)), log(1 / 200)) for pair, n in bigrams.items()}
        self.rest = {first: max(log(0.5 / (n + 20)), log(1 / 200)) for first, n in totals.items()}

    def _step(self, before: str, char: str) -> float:
        """Score of ``char`` after ``before`` inside a word."""
        if script(before if char == "$" else char) not in self.known:
            return UNKNOWN
        follows = before == "^" or char == "$" or script(before) == script(char)
        pair = (before if follows else "^").lower() + char.lower()
        return self.scores.get(pair, self.rest.get(pair[0], UNKNOWN))

    def word(self, word: str, home: str) -> str:
        """The best reading of a decomposed word in a text whose letters are mostly of script ``home``."""
        bases = [c for c in word if not unicodedata.combining(c)]
        # a letter is only read in a script that the word or its text has
        there = {script(c) for c in bases} | {home}
        paths: dict[str, tuple[float, str]] = {"^": (0.0, "")}
        for base in bases:
            new: dict[str, tuple[float, str]] = {}
            for char in dict.fromkeys(base + "".join(c for c in READINGS.get(base, "") if script(c) in there)):
                cost = 0.0 if char == base else CHANGE
                if home and script(char) not in ("", home):
                    cost += FOREIGN
                best = max(((score + cost + self._step(before, char) + (SWITCH if before != "^" and script(before) and script(char) and script(before) != script(char) else 0), path + char) for before, (score, path) in paths.items()), key=lambda x: x[0])
                new[char] = best
            paths = new
        _, best_path = max(((score + self._step(last, "$"), path) for last, (score, path) in paths.items()), key=lambda x: x[0])
        read = iter(best_path)
        return "".join(c if unicodedata.combining(c) else next(read) for c in word)

    def read(self, text: str) -> str:
        """The consistent form of a text."""
        text = compatible(text)
        if text.isascii():
            return text
        apart = unicodedata.normalize("NFD", text)
        doubtful = [m for m in LETTERS.finditer(apart) if any(c in READINGS and not c.isascii() for c in m.group()) or len({script(c) for c in m.group() if script(c)}) > 1]
        if not doubtful:
            return text
        # letters without look-alikes, and plain ones, tell the script that the text is in
        votes: dict[str, int] = {}
        for c in apart:
            if script(c) and (c.isascii() or c not in READINGS):
                votes[script(c)] = votes.get(script(c), 0) + 1
        home = max(votes, key=votes.__getitem__) if votes else "LATIN"
        if home == "CJK":
            votes.pop("CJK")
            home = max(votes, key=votes.__getitem__) if votes else "LATIN"
        out, at = [], 0
        for m in doubtful:
            word = m.group()
            certain = {script(c) for c in word if script(c) and (c not in READINGS)}
            out += [apart[at : m.start()], self.word(word, home if not certain else "")]
            at = m.end()
        return unicodedata.normalize("NFC", "".join(out) + apart[at:])


def letter_bigrams(clean: DataFrame, text: str) -> dict[str, int]:
    """Counts of letter pairs in clean texts of any alphabet, each script's among its own. There are at most as many as pairs of letters of alphabets."""
    words = clean.select(F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[\p{L}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}]]+"), F.lit(0))).alias("word"))
    marked = words.select(F.concat(F.lit("^"), "word", F.lit("$")).alias("word"))
    pairs = marked.select(F.explode(F.sequence(F.lit(1), F.char_length("word") - 1)).alias("at"), "word").select(F.substring(F.col("word"), F.col("at"), F.lit(2)).alias("pair"))
    return {r["pair"]: r["n"] for r in pairs.groupBy("pair").agg(F.count("*").alias("n")).collect()}


def consistent(texts: DataFrame, text: str, form: str, bigrams: dict[str, int]) -> DataFrame:
    """``texts`` with a column ``form``: its text in the one consistent form. Each distinct text of a batch is read once."""

    def run(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = Reader(bigrams)
        known: dict[str, str] = {}
        for column in columns:
            if len(known) > 200_000:
                known.clear()
            for t in column.dropna().unique():
                if t not in known:
                    known[t] = reader.read(t)
            yield column.map(known, na_action="ignore")

    return texts.withColumn(form, F.pandas_udf(run, "string")(F.col(text)))


def look_alike_matches(texts: DataFrame, row_id: str, text: str, references: DataFrame, ref_id: str, ref_text: str, bigrams: dict[str, int] | None = None) -> DataFrame:
    """(row_id, ref_id) of every text that has a reference's consistent form but other code points."""
    clean = references.select(F.col(ref_id).alias("ref_id"), F.col(ref_text).alias("ref_text")).where("ref_text <> ''")
    bigrams = bigrams if bigrams is not None else letter_bigrams(clean, "ref_text")
    rows = consistent(texts.select(F.col(row_id).alias("row_id"), F.col(text).alias("text")), "text", "form", bigrams)
    forms = materialize(consistent(clean, "ref_text", "form", bigrams), "forms")
    return rows.join(small_or_shuffled(forms), "form").where("text <> ref_text").select("row_id", "ref_id")
