"""Per-document text statistics and the shapes they show: prose, list, table or junk.

Texts are split into chunks. Each chunk gives additive counts and its boundary state: the word
run and the line that may continue over either border. Partial results merge associatively, so
the chunks of a huge document are merged in a tree, a fan-in at a time; a document of one chunk
is finished where it is read. Ratios and shapes follow from the merged counts.

A word is a Han character or a run of other letters, marks and digits. All counts are exact and
don't depend on where a text is cut: a run over a border is kept whole until its end is seen, and
words and characters are counted without a limit. A state never holds more than the text it is of.

Defined results: null, empty and blank texts have zero counts, null ratios and no shape; line
ends may be mixed.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosescan.functions.scratch import materialize

#: Characters of a chunk; partial results merged at once.
CHUNK_CHARS = 16_384
FAN_IN = 64
#: Latin letters beyond which their share of vowels tells a text from random ones.
LEAST_LETTERS = 24
#: Characters of a line's opening, behind its blanks, that are enough to tell an item: the longest sign of one has six.
OPENING = 96

# Words that running text of either language cannot do without.
COMMON_WORDS = (
    "a about after all an and are as at be been but by can could did do every few first for from had has have he her his how i if in is it its "
    "just like more most my no not of on one or our out she so some than that the their them then there these they this to too until up was we "
    "were what when where which who why will with would yet you your "
    "的 了 是 在 有 和 不 这 那 我 你 他 她 它 们 也 都 就 把 被 从 到 对 与 很 又 还 再 先 去 来 上 下 里 着 过 得 吗 呢 吧 没"
)
# Signs that close a line of prose, and sentences.
END_MARKS = ".!?…。！？；;:：\"”’'）)」』"
SENTENCE_ENDS = ".!?。！？"
# Signs that open an item.
BULLETS = "•·●○◦▪▫■□◆◇★☆‣⁃∙※►▶▸➤➜➔→⇒⟶»☐☑☒✓✔✗✘✅🔹🔸👉➡–—―−"

COMMON = frozenset(COMMON_WORDS.split())
RUN = regex.compile(r"\p{Han}+|[[\p{L}\p{M}\p{N}]--[\p{Han}]]+", regex.V1)
HAN = regex.compile(r"\p{Han}")
SYMBOL = regex.compile(r"[^\p{L}\p{M}\p{N}\s]")
BREAK = regex.compile(r"\r\n|[\n\r  \x85\v\f]")
ITEM = regex.compile(
    rf"(?:[{BULLETS}]|[-*+>](?=\s)|\[[ xX✓✔]?\]|☐|[(（](?:\p{{Nd}}{{1,3}}|[A-Za-z]|[ivxIVX]{{1,4}}|[一二三四五六七八九十]{{1,3}})[)）]"
    r"|#?\p{Nd}{1,3}[.)、．）:：](?!\p{Nd})|#\p{Nd}{1,3}(?=\s)|[A-Za-z][.)、）](?=\s)|[ivxIVX]{1,4}[.)）](?=\s)|[一二三四五六七八九十]{1,3}[、.．)）]|[①-⑳⑴-⒇⒈-⒛])"
)
VOWEL = regex.compile(r"[aeiouyAEIOUYà-æè-ïò-öù-ýÀ-ÆÈ-ÏÒ-ÖÙ-Ýāēīōūăĕĭŏŭąęįųơưÿœ]")
CLUSTER = regex.compile(rf"(?:(?!{VOWEL.pattern})\p{{L}}){{5}}")
LATIN_LETTER = regex.compile(r"\p{Latin}")
LATIN = regex.compile(r"[\p{Latin}\p{M}]+")
REGULAR = regex.compile(r"\p{Lu}?[\p{Ll}\p{M}]+|[\p{Lu}\p{M}]+|\p{Lu}[\p{Ll}\p{M}]+\p{Lu}[\p{Ll}\p{M}]+")
SEPARATORS = "|│\t,;"
GAP = regex.compile(r" {2,}")
BLANK = "\ufeff \t"
#: White space and byte order marks before a line's opening.
INDENT = BLANK + "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def _is_word(run: str) -> bool:
    """Whether a run may be a word of some language: letters of usual case, length and sound, or a small number."""
    if len(run) == 1:
        return run in "aAiIoOyYeEuU" or not LATIN.match(run) and run.isalnum()
    if not LATIN.fullmatch(run):
        return len(run) == 2 and run.isdigit() or not any(c.isdigit() for c in run) and not regex.search(r"\p{Latin}", run)
    return len(run) <= 24 and bool(REGULAR.fullmatch(run)) and bool(VOWEL.search(run)) and not CLUSTER.search(run)


def _unit(run: str) -> tuple[str, int]:
    """A run that repeats one short unit dozens of times, as that unit's least rotation and its repeats; else itself, once."""
    n = len(run)
    if n >= 24:
        for p in range(1, min(25, n // 8 + 1)):
            if run[p:] == run[:-p]:
                return min(run[i:p] + run[:i] for i in range(p)), n // p
    return run, 1


@lru_cache(maxsize=100_000)
def _judged(run: str) -> tuple[int, int, int, int, str, int]:
    """Words, characters, word-like characters, common words, unit and repeats of a run."""
    unit, repeats = _unit(run)
    size = len(run)
    if HAN.match(run):
        return size, size, size, sum(c in COMMON for c in run), unit, repeats
    return 1, size, size if repeats == 1 and _is_word(run) else 0, int(run.lower() in COMMON), unit.casefold(), repeats


@lru_cache(maxsize=20_000)
def _traits(char: str) -> tuple[bool, bool, bool, bool]:
    """Whether a character is white space, a symbol, a Latin letter, a vowel."""
    return char.isspace(), SYMBOL.match(char) is not None, LATIN_LETTER.match(char) is not None, VOWEL.match(char) is not None


class Line:
    """State of a line or of the part of it that a chunk holds."""

    __slots__ = ("opening", "raw", "last", "filled", "seps", "gaps", "lead", "trail")

    def __init__(self, text: str):
        self.raw = text[:OPENING]
        self.opening = text.lstrip(INDENT)[:OPENING]
        body = text.strip().strip(BLANK)
        self.filled = len(body)
        self.last = body[-1] if body else ""
        self.seps = tuple(map(text.count, SEPARATORS))
        inner = text.lstrip(" ")
        self.lead = len(text) - len(inner)
        inner = inner.rstrip(" ")
        self.trail = len(text) - self.lead - len(inner)
        self.gaps = len(GAP.findall(inner)) if "  " in inner else 0

    def joined(self, right: Line) -> Line:
        out = object.__new__(Line)
        out.raw = (self.raw + right.raw)[:OPENING]
        # an opening starts behind the blanks of its line; what follows it keeps its own
        out.opening = (self.opening + right.raw)[:OPENING] if self.opening else right.opening
        out.last = right.last or self.last
        out.filled = self.filled + right.filled
        out.seps = tuple(a + b for a, b in zip(self.seps, right.seps, strict=True))
        between = self.trail + right.lead
        out.gaps = self.gaps + right.gaps + (1 if self.filled and right.filled and between >= 2 else 0)
        out.lead = self.lead if self.filled else between
        out.trail = right.trail if right.filled else between
        return out

    def add_to(self, p: Partial) -> None:
        """Count a whole line."""
        p.n_lines += 1
        if not self.filled:
            return
        p.n_filled += 1
        p.n_ended += self.last in END_MARKS
        start = self.opening
        p.n_items += ITEM.match(start) is not None
        outer = (start[:1] in "|│") + (self.last in "|│")
        best = 0
        for i, n in enumerate(self.seps):
            cells = n + 1 - (outer if SEPARATORS[i] in "|│" else 0)
            prose = SEPARATORS[i] in ",;" and self.last in SENTENCE_ENDS
            if cells >= 3 and not prose and self.filled / cells <= 30:
                p.rows[i, cells] += 1
                best = 1
        if not best and self.gaps >= 2 and self.last not in SENTENCE_ENDS and self.filled / (self.gaps + 1) <= 40:
            p.rows[len(self.seps), self.gaps + 1] += 1


class Partial:
    """Counts of a chunk or of several merged ones, and the state at their borders."""

    SUMS = ("n_chars", "n_space", "n_symbols", "n_words", "word_chars", "good_chars", "common", "n_lines", "n_filled", "n_ended", "n_items", "n_latin", "n_vowels")
    __slots__ = (*SUMS, "words", "chars", "rows", "head", "tail", "solid", "first", "last", "one_line", "starts_lf", "ends_cr")

    def __init__(self, text: str):
        for s in self.SUMS:
            setattr(self, s, 0)
        self.words, self.rows = Counter(), Counter()
        self.n_chars = len(text)
        self.chars = Counter(text)
        for c, n in list(self.chars.items()):
            space, symbol, latin, vowel = _traits(c)
            if space:
                self.n_space += n
                del self.chars[c]
            elif symbol:
                self.n_symbols += n
            elif latin:
                self.n_latin += n
                self.n_vowels += n if vowel else 0
        runs = RUN.findall(text)
        self.head = self.tail = ""
        self.solid = False
        if runs and text.startswith(runs[0]):
            self.head = runs.pop(0)
            self.solid = self.head == text
        if runs and text.endswith(runs[-1]):
            self.tail = runs.pop()
        n_words = word_chars = good_chars = n_common = 0
        for run, n in Counter(runs).items():
            words, size, good, common, unit, repeats = _judged(run)
            self.words[unit] += repeats * n
            n_words += words * n
            word_chars += size * n
            good_chars += good * n
            n_common += common * n
        self.n_words, self.word_chars, self.good_chars, self.common = n_words, word_chars, good_chars, n_common
        self.starts_lf, self.ends_cr = text[:1] == "\n", text[-1:] == "\r"
        lines = BREAK.split(text)
        self.one_line = len(lines) == 1
        self.first, self.last = Line(lines[0]), None if self.one_line else Line(lines[-1])
        for line in lines[1:-1]:
            Line(line).add_to(self)

    def _count(self, run: str, n: int = 1) -> None:
        words, size, good, common, unit, repeats = _judged(run)
        self.words[unit] += repeats * n
        self.n_words += words * n
        self.word_chars += size * n
        self.good_chars += good * n
        self.common += common * n

    def merged(self, right: Partial) -> Partial:
        """This one followed by ``right``, in place."""
        if not right.n_chars:
            return self
        if not self.n_chars:
            return right
        for s in self.SUMS:
            setattr(self, s, getattr(self, s) + getattr(right, s))
        for mine, other in ((self.words, right.words), (self.chars, right.chars), (self.rows, right.rows)):
            mine.update(other)
        left, next_ = self.head if self.solid else self.tail, right.head
        if left and next_ and bool(HAN.match(left)) == bool(HAN.match(next_)):
            over, solid = left + next_, self.solid and right.solid
            if self.solid:
                self.head, self.tail = over, right.tail
            elif right.solid:
                self.tail = over
            else:
                self._count(over)
                self.tail = right.tail
            self.solid = solid
        else:
            # both runs end at the border; one that reaches the outer border as well is counted when all is merged
            if not self.solid and left:
                self._count(left)
            if not right.solid and next_:
                self._count(next_)
            self.tail, self.solid = next_ if right.solid else right.tail, False
        middle = self.first if self.one_line else self.last
        if self.ends_cr and right.starts_lf:
            # one line end came in two parts: the empty line between them doesn't exist
            if right.one_line:
                raise AssertionError("a chunk that starts with a line end has one")
            if self.one_line:
                raise AssertionError("a chunk that ends with a line end has one")
            self.last = right.last
        else:
            joined = middle.joined(right.first)
            if self.one_line and right.one_line:
                self.first = joined
            elif self.one_line:
                self.first, self.last, self.one_line = joined, right.last, False
            elif right.one_line:
                self.last = joined
            else:
                joined.add_to(self)
                self.last = right.last
        self.ends_cr = right.ends_cr
        return self

    def finished(self) -> dict:
        """Counts, ratios and shape of the whole text."""
        for run in (self.head, self.tail):
            if run:
                self._count(run)
        self.head = self.tail = ""
        for line in (self.first, self.last):
            if line is not None:
                line.add_to(self)
        ink = self.n_chars - self.n_space
        share = lambda n, of: n / of if of else None
        out = {"n_chars": self.n_chars, "n_words": self.n_words, "n_lines": self.n_filled}
        out |= {"mean_word_length": share(self.word_chars, self.n_words), "symbol_ratio": share(self.n_symbols, ink), "line_end_share": share(self.n_ended, self.n_filled), "common_share": share(self.common, self.n_words), "word_like_share": share(self.good_chars, ink)}
        out |= {"item_share": share(self.n_items, self.n_filled), "row_share": share(max(self.rows.values(), default=0), self.n_filled)}
        word, times = max(self.words.items(), key=lambda x: x[1] * len(x[0]), default=("", 0))
        char_times = max(self.chars.values(), default=0)
        letters = max(self.word_chars, 1)
        repeated = times >= 24 and times * len(word) >= 0.75 * letters and times * len(word) >= 0.4 * ink or char_times >= 24 and char_times >= 0.75 * ink
        out["shape"] = None
        if self.n_filled >= 4 and 3 * max(self.rows.values(), default=0) >= 2 * self.n_filled:
            out["shape"] = "table"
        elif self.n_filled >= 4 and 3 * self.n_items >= 2 * self.n_filled:
            out["shape"] = "list"
        elif repeated or ink >= 12 and (self.good_chars < 0.5 * ink or self.n_latin > max(0.5 * ink, LEAST_LETTERS) and self.n_vowels < 0.22 * self.n_latin):
            out["shape"] = "junk"
        return out


STATS = "n_chars bigint, n_words bigint, n_lines bigint, mean_word_length double, symbol_ratio double, line_end_share double, common_share double, word_like_share double, item_share double, row_share double, shape string"
STAT_NAMES = [x.split()[0] for x in STATS.split(", ")]


def _rows(ids: list, partials: list[Partial], schema: pa.Schema) -> pa.RecordBatch:
    done = [p.finished() for p in partials]
    return pa.RecordBatch.from_pydict({"row_id": ids} | {k: [d[k] for d in done] for k in STAT_NAMES}, schema=schema)


def text_statistics(texts: DataFrame, row_id: str, text: str, chunk_chars: int = CHUNK_CHARS, fan_in: int = FAN_IN) -> DataFrame:
    """Statistics and shape of every text; the columns are ``STAT_NAMES`` after the id.

    ``shape`` is 'list', 'table', 'junk' or null. Ids must be unique.
    """
    kind = texts.schema[row_id].dataType.simpleString()
    chosen = texts.select(texts[row_id].alias("row_id"), F.coalesce(texts[text], F.lit("")).alias("text"))
    whole = F.char_length("text") <= chunk_chars
    cut = F.when(whole, F.array("text")).otherwise(F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{chunk_chars}}}"), F.lit(0)))
    chunks = chosen.select("row_id", cut.alias("chunks")).select("row_id", F.size("chunks").alias("n"), F.posexplode(F.filter("chunks", lambda c: c.isNotNull())).alias("k", "chunk"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            many = b.column("n").to_pylist()
            parts = [Partial(t) for t in b.column("chunk").to_pylist()]
            done = [p.finished() if n == 1 else dict.fromkeys(STAT_NAMES) for p, n in zip(parts, many, strict=True)]
            state = [pickle.dumps([getattr(p, s) for s in Partial.__slots__], 5) if n > 1 else None for p, n in zip(parts, many, strict=True)]
            columns = {"row_id": b.column("row_id"), "n": b.column("n"), "k": b.column("k"), "state": pa.array(state, pa.binary())}
            yield pa.RecordBatch.from_pydict(columns | {k: pa.array([d[k] for d in done], ARROW[k]) for k in STAT_NAMES})

    counted = chunks.mapInArrow(count, f"row_id {kind}, n int, k int, state binary, {STATS}")
    counted = materialize(counted, "partials")
    single = counted.where("n = 1").select("row_id", *STAT_NAMES)
    parts = counted.where("n > 1").select("row_id", "n", "k", "state")
    longest = parts.agg(F.max("n")).first()[0] or 1
    while longest > 1:
        longest = -(-longest // fan_in)
        parts = _merged(parts, kind, fan_in, last=longest == 1)
    merged = parts.select("row_id", *STAT_NAMES) if "n_chars" in parts.columns else single.limit(0)
    return single.unionByName(merged).withColumnRenamed("row_id", row_id)


ARROW = {k: {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}[x.split()[1]] for k, x in zip(STAT_NAMES, STATS.split(", "), strict=True)}


def _merged(parts: DataFrame, kind: str, fan_in: int, last: bool) -> DataFrame:
    """Each run of ``fan_in`` partial results of a text merged into one; at ``last``, finished."""
    parts = parts.withColumn("up", F.floor(F.col("k") / fan_in).cast("int")).repartition("row_id", "up").sortWithinPartitions("row_id", "up", "k")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for b in batches:
            ids, ups, states, ns = ([], [], [], [])
            done_ids, done = [], []
            for row, up, n, state in zip(b.column("row_id").to_pylist(), b.column("up").to_pylist(), b.column("n").to_pylist(), b.column("state").to_pylist(), strict=True):
                part = object.__new__(Partial)
                for s, v in zip(Partial.__slots__, pickle.loads(state), strict=True):
                    setattr(part, s, v)
                if at == (row, up, n):
                    held = held.merged(part)
                else:
                    if held is not None:
                        done_ids.append(at)
                        done.append(held)
                    at, held = (row, up, n), part
            yield from _given(done_ids, done)
        if held is not None:
            yield from _given([at], [held])

    def _given(keys: list, partials: list[Partial]) -> Iterator[pa.RecordBatch]:
        if not keys:
            return
        columns = {"row_id": pa.array([k[0] for k in keys], ID)}
        if last:
            done = [p.finished() for p in partials]
            yield pa.RecordBatch.from_pydict(columns | {k: pa.array([d[k] for d in done], ARROW[k]) for k in STAT_NAMES})
        else:
            columns |= {"n": pa.array([k[2] for k in keys], pa.int32()), "k": pa.array([k[1] for k in keys], pa.int32())}
            yield pa.RecordBatch.from_pydict(columns | {"state": pa.array([pickle.dumps([getattr(p, s) for s in Partial.__slots__], 5) for p in partials], pa.binary())})

    from pyspark.sql.pandas.types import to_arrow_type

    ID = to_arrow_type(parts.schema["row_id"].dataType)  # noqa: N806
    return parts.mapInArrow(merge, f"row_id {kind}, {STATS}" if last else f"row_id {kind}, n int, k int, state binary")
