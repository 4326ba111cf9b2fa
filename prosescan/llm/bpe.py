"""Byte-level BPE encoding of whole collections in numpy.

Texts are cut into pieces by the vocabulary's published pattern; each distinct piece of a batch
is encoded once. Pieces of similar length share a padded matrix of symbols, and in every round
each row merges its minimum-rank pair, the leftmost occurrence first; further occurrences that
don't overlap it follow in the same round, which gives the same ids because no merge can create
a pair of lower rank. Ranks come from an open-addressing hash table of symbol pairs; finished
rows leave the matrix and columns that no row needs are dropped.

Defined results: null and empty texts have an empty list; strings of special tokens in a text are
ordinary text; unpaired surrogates cannot occur in UTF-8 columns.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Pieces whose ids a worker remembers from batch to batch; the memory is emptied when full.
REMEMBERED = 400_000
#: Symbols in one matrix.
CELLS = 1 << 20
#: Batch of texts, in characters, that is cut and encoded at once.
BATCH_CHARS = 1 << 21


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file, by its published rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PairTable:
    """Hash table from symbol pairs to (rank, merged symbol), with linear probing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(left)) * 4))))
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.ranks = np.full(size, NO_RANK, np.int32)
        self.merged = np.zeros(size, np.int32)
        keys = left.astype(np.int64) << 32 | right
        waiting = np.arange(len(keys))
        slots = self._slot(keys)
        while len(waiting):
            free = self.keys[slots[waiting]] == -1
            _, first = np.unique(slots[waiting[free]], return_index=True)
            put = waiting[free][first]
            self.keys[slots[put]], self.ranks[slots[put]], self.merged[slots[put]] = keys[put], put, merged[put]
            waiting = np.setdiff1d(waiting, put, assume_unique=True)
            slots[waiting] = (slots[waiting] + 1) & (size - 1)
        self.merged_by_rank = merged.astype(np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NO_RANK where it never merges."""
        keys = left.astype(np.int64) << 32 | right
        slots = self._slot(keys)
        out = np.full(keys.shape, NO_RANK, np.int32)
        open_ = np.arange(keys.size)
        flat, at = keys.ravel(), slots.ravel()
        result = out.ravel()
        while len(open_):
            held = self.keys[at[open_]]
            hit = held == flat[open_]
            result[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (held != -1)]
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
        return result.reshape(keys.shape)


NO_RANK = np.int32(2**31 - 1)


class Encoder:
    """Encoder for one byte-level vocabulary file with its merges in order."""

    def __init__(self, path: str):
        import public_tokenizers

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids, to_byte = model["vocab"], _byte_symbols()
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        as_ids = np.array([(ids[a], ids[b], ids[a + b]) for a, b in pairs], np.int64).reshape(-1, 3)
        self.of_byte = np.zeros(256, np.int32)
        for char, byte in to_byte.items():
            self.of_byte[byte] = ids[char]
        self.table = PairTable(as_ids[:, 0], as_ids[:, 1], as_ids[:, 2])
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.known: dict[str, list[int]] = {}

    def _merge_all(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge every row of the padded matrix to its end; padding is -1."""
        done = np.zeros_like(symbols)
        done_len = np.zeros(len(symbols), np.int64)
        rows = np.arange(len(symbols))
        while len(rows):
            width = symbols.shape[1]
            if width > 1:
                ranks = self.table.rank(symbols[:, :-1], symbols[:, 1:])
                ranks[symbols[:, 1:] < 0] = NO_RANK
                least = ranks.min(axis=1)
            else:
                least = np.full(len(rows), NO_RANK, np.int32)
            ended = least == NO_RANK
            if ended.any():
                done[rows[ended], :width] = symbols[ended]
                done_len[rows[ended]] = lengths[ended]
                rows, symbols, lengths = rows[~ended], symbols[~ended], lengths[~ended]
                if not len(rows):
                    break
                ranks, least = ranks[~ended], least[~ended]
            hit = ranks == least[:, None]
            # of touching occurrences every second one stays, counted from the left
            column = np.arange(hit.shape[1])
            before = np.maximum.accumulate(np.where(hit, -1, column), axis=1)
            hit &= (column - before) % 2 == 1
            r, c = np.nonzero(hit)
            symbols[r, c] = self.table.merged_by_rank[least[r]]
            symbols[r, c + 1] = -2
            keep = symbols >= 0
            lengths = keep.sum(axis=1)
            packed = np.full((len(rows), int(lengths.max())), -1, np.int32)
            kr, kc = np.nonzero(keep)
            packed[kr, (np.cumsum(keep, axis=1) - 1)[kr, kc]] = symbols[kr, kc]
            symbols = packed
        return done, done_len

    def encode_pieces(self, pieces: list[str]) -> None:
        """Add the ids of distinct pieces to what is known."""
        raw = [p.encode("utf-8") for p in pieces]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        order = np.argsort(sizes, kind="stable")
        start = 0
        while start < len(order):
            # a bucket holds lengths up to a quarter above its shortest, within the matrix size
            top = int(sizes[order[start]] * 1.25) + 1
            end = int(np.searchsorted(sizes[order], top, side="right"))
            end = min(end, start + max(1, CELLS // top))
            rows = order[start:end]
            lengths = sizes[rows]
            matrix = np.full((len(rows), int(lengths.max())), -1, np.int32)
            flat = self.of_byte[np.frombuffer(b"".join(raw[i] for i in rows), np.uint8)]
            matrix[np.arange(matrix.shape[1]) < lengths[:, None]] = flat
            out, out_len = self._merge_all(matrix, lengths)
            for i, line, n in zip(rows.tolist(), out, out_len.tolist(), strict=True):
                self.known[pieces[i]] = line[:n].tolist()
            start = end

    def encode(self, texts: Iterable[str | None]) -> list[list[int]]:
        """Ids of each text."""
        cut = [self.pattern.findall(t) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = {p for pieces in cut for p in pieces if p not in self.known}
        if new:
            self.encode_pieces(sorted(new))
        known = self.known
        return [[i for p in pieces for i in known[p]] for pieces in cut]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _in_batches(texts: list[str | None]) -> Iterator[list[str | None]]:
    part: list[str | None] = []
    chars = 0
    for t in texts:
        part.append(t)
        chars += len(t or "")
        if chars >= BATCH_CHARS:
            yield part
            part, chars = [], 0
    if part:
        yield part


def encode_column(texts: DataFrame, row_id: str, text: str, vocabulary: str | None = None) -> DataFrame:
    """(row_id, ids array<int>) of every row; one pass without a shuffle.

    ``vocabulary`` is the path of the vocabulary file, which every executor must have.
    """
    path = vocabulary or vocabulary_path("byte_bpe_50k.json")
    chosen = texts.select(texts[row_id].alias("row_id"), texts[text].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            at = 0
            for part in _in_batches(batch.column("text").to_pylist()):
                ids = own.encode(part)
                sizes = np.fromiter(map(len, ids), np.int64, len(ids))
                flat = np.fromiter((i for x in ids for i in x), np.int32, int(sizes.sum()))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("row_id").slice(at, len(part)), lists], ["row_id", "ids"])
                at += len(part)

    kind = chosen.schema["row_id"].dataType.simpleString()
    return chosen.mapInArrow(run, f"row_id {kind}, ids array<int>").withColumnRenamed("row_id", row_id)


def token_counts(texts: DataFrame, row_id: str, text: str, vocabulary: str | None = None) -> DataFrame:
    """(row_id, n_tokens int) of every row."""
    path = vocabulary or vocabulary_path("byte_bpe_50k.json")
    chosen = texts.select(texts[row_id].alias("row_id"), texts[text].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            at = 0
            for part in _in_batches(batch.column("text").to_pylist()):
                sizes = np.fromiter(map(len, own.encode(part)), np.int32, len(part))
                yield pa.RecordBatch.from_arrays([batch.column("row_id").slice(at, len(part)), pa.array(sizes, pa.int32())], ["row_id", "n_tokens"])
                at += len(part)

    kind = chosen.schema["row_id"].dataType.simpleString()
    return chosen.mapInArrow(run, f"row_id {kind}, n_tokens int").withColumnRenamed("row_id", row_id)
