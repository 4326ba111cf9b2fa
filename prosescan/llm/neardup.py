"""Near-duplicate records: pairs whose words agree in a share of at least 0.8, and their groups.

Words, tagged with their occurrence, are a set. Each record is embedded as its numbers of words in
``SEGMENTS`` segments, whose Manhattan distance is a lower bound of the number of words that differ;
counts are kept in unary, so that the distance is the popcount of two records' differing bits.
Candidates share a cell of one of many layouts: a cell is the tuple of a layout's min-wise
coordinates, drawn from all words alike. Cells are joined bucket by bucket; a pair beyond the
Manhattan bound is dropped where it is found, the others are verified on their words exactly.

Every coordinate agrees with the share of the words of both that they have in common, whichever
words differ, so the chance that a pair at the threshold shares no cell is at most ``MISS`` and
falls steeply above it (under 1e-11 at a similarity of 0.87). There is no cap on cells, candidates
or partners: a cell of more than ``HOT`` records is split into pairs of blocks that other tasks take.
The number of coordinates follows the number of records, so that cells stay small; layouts, and with
them the keys of a record, grow about as its power 0.2.

Defined results: null fields are empty; records without any word resemble nothing; exact copies
are candidates by their equality, not by cells; ids must be unique integers; an empty table has no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import ceil, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from prosescan.functions.scratch import join_by_frequency, materialize, small_or_shuffled

#: Chance that a pair at the threshold shares no cell; similarity that unrelated records seldom exceed (as common over all words); least coordinates of a layout.
MISS, FAR, LEAST_COORDINATES = 1e-5, 0.15, 5
#: Segments of the embedding and the count at which one is full.
SEGMENTS, FULL = 64, 3
#: Keys of a bucket; records of a cell, or copies of one record, from which it is split.
BUCKET_KEYS, HOT = 2_000_000, 4096


def layouts(n: int, similarity: float) -> tuple[int, int]:
    """Coordinates of a layout and number of layouts for ``n`` records."""
    both = similarity / (2 - similarity)
    coordinates = max(LEAST_COORDINATES, ceil(log(max(n, 16) / 16) / -log(FAR)))
    return coordinates, ceil(log(MISS) / log(1 - both**coordinates))


def _tagged(batch: pa.RecordBatch, fields: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each row, tagged with their occurrence, in one canonical order; and the rows' ends."""
    joined = pc.binary_join_element_wise(*[pc.cast(batch.column(f), pa.string()) for f in fields], " ", null_handling="replace", null_replacement="")
    split = pc.split_pattern_regex(pc.utf8_lower(joined), pattern=r"[^\p{L}\p{Nd}]+")
    rows = pc.list_parent_indices(split).to_numpy(zero_copy_only=False)
    coded = split.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    hashes = np.array([xxhash.xxh64_intdigest(w.encode()) for w in words], np.uint64)
    order = np.argsort(hashes)
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words))
    word = place[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int64)
    filled = np.array([bool(w) for w in words], bool)[order]
    keep = filled[word] if len(words) else np.zeros(0, bool)
    key = np.sort(rows[keep].astype(np.int64) * max(1, len(words)) + word[keep])
    row, word = key // max(1, len(words)), key % max(1, len(words))
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    nth = np.arange(len(key)) - np.repeat(first, np.diff(np.r_[first, len(key)]))
    tagged = _mixed(hashes[order][word] + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) if len(key) else np.zeros(0, np.uint64)
    return tagged, np.cumsum(np.bincount(row, minlength=batch.num_rows))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing of integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tokenized(records: DataFrame, row_id: str, fields: Sequence[str]) -> DataFrame:
    """(id, m, words): number of words and hashes of the tagged words of each record."""
    kind = records.schema[row_id].dataType.simpleString()
    chosen = records.select(F.col(row_id).alias("id"), *[F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(fields)])
    names = [f"f{i}" for i in range(len(fields))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, ends = _tagged(b, names)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(flat.view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.diff(np.r_[0, ends]), pa.int32()), lists], ["id", "m", "words"])

    return chosen.mapInArrow(run, f"id {kind}, m int, words array<bigint>")


def _embedded(words: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """One row of ``FULL`` integers per record: bit s of the k-th says whether segment s has more than k words."""
    counts = np.bincount(row * SEGMENTS + (words >> np.uint64(58)).astype(np.int64), minlength=n * SEGMENTS).reshape(n, SEGMENTS)
    return np.stack([np.packbits(counts > k, axis=1).view(np.uint64)[:, 0] for k in range(FULL)], axis=1)


def _minima(kinds: np.ndarray, at: np.ndarray, starts: np.ndarray, first: int, n: int) -> Iterator[np.ndarray]:
    """Min-wise coordinates ``first`` and on, ``n`` of them, of all records, whose words are ``kinds`` at the places ``at``; each record has a word."""
    for c in range(first, first + n):
        salt = _mixed(np.array([c + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15))[0]
        yield np.minimum.reduceat((_mixed(kinds ^ salt) >> np.uint64(32)).astype(np.uint32)[at], starts)


def _packed(ids: np.ndarray, m: np.ndarray, embedded: np.ndarray, keys: np.ndarray) -> bytes:
    """Records of a block and their keys, column by column."""
    return b"".join([np.array([len(ids), keys.size], np.int64).tobytes(), ids.tobytes(), m.astype(np.uint32).tobytes(), embedded.T.tobytes(), keys.tobytes()])


def _unpacked(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, k = (int(x) for x in np.frombuffer(block, np.int64, 2))
    at = 16
    out = []
    for kind, size in ((np.int64, n), (np.uint32, n), (np.uint64, FULL * n), (np.uint32, k)):
        out.append(np.frombuffer(block, kind, size, at))
        at += size * kind().nbytes
    return out[0], out[1].astype(np.int64), out[2].reshape(FULL, n).T, out[3]


def keyed(words: DataFrame, n: int, similarity: float, cores: int) -> tuple[DataFrame, int]:
    """(bucket, block) of all records that have words, in every bucket with their keys there; and the number of buckets.

    A bucket holds some layouts of all records or, where records are many, a part of one layout's cells.
    """
    coordinates, many = layouts(n, similarity)
    per = max(1, min(BUCKET_KEYS // max(n, 1), ceil(many / (2 * cores))))
    parts = ceil(n / BUCKET_KEYS) if per == 1 else 1
    groups = ceil(many / per)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("words")
            m = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(m):
                continue
            flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            starts = np.r_[0, np.cumsum(m)[:-1]]
            ids = b.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
            kinds, at = np.unique(flat, return_inverse=True)
            embedded = _embedded(flat, np.repeat(np.arange(len(m)), m), len(m))
            for g in range(groups):
                keys = []
                for k in range(g * per, min(many, (g + 1) * per)):
                    key = np.full(len(m), k, np.uint64)
                    for c in _minima(kinds, at, starts, k * coordinates, coordinates):
                        key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) ^ c)
                    keys.append(key)
                keys = np.stack(keys)
                for part in range(parts):
                    own = slice(None) if parts == 1 else np.flatnonzero((keys[0] >> np.uint64(32)) % np.uint64(parts) == part)
                    block = _packed(ids[own], m[own], embedded[own], keys[:, own].astype(np.uint32))
                    yield pa.RecordBatch.from_arrays([pa.array([g * parts + part], pa.int32()), pa.array([block], pa.binary())], ["bucket", "block"])

    return words.where("m > 0").select("id", "words").mapInArrow(run, "bucket int, block binary"), groups * parts


def _near(x: tuple, i: np.ndarray, y: tuple, j: np.ndarray, apart: float) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs (row i of x, row j of y) that the Manhattan distance doesn't rule out."""
    (_, mx, ex, *_), (_, my, ey, *_) = x, y
    most = apart * (mx[i] + my[j]) + 1e-9
    far = np.zeros(len(i), np.int64)
    for k in range(FULL):
        far += np.bitwise_count(ex[i, k] ^ ey[j, k])
    keep = far <= most
    return i[keep], j[keep]


def candidates(blocks: DataFrame, buckets: int, similarity: float) -> DataFrame:
    """(a, b), a < b: pairs of records that share a cell and that the Manhattan distance doesn't rule out; a pair may come from several buckets."""
    apart = 1 - similarity
    shape = "a bigint, b bigint, left binary, right binary"
    none = lambda n: pa.nulls(n, pa.binary())

    def found(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)[a != b], axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), none(len(pairs)), none(len(pairs))], ["a", "b", "left", "right"])

    def bucket(held: list[bytes]) -> Iterator[pa.RecordBatch]:
        read = [_unpacked(x) for x in held]
        x = tuple(np.concatenate([r[k] for r in read]) for k in range(3))
        ends = np.cumsum([len(r[0]) for r in read])
        # a key is that of its layout within the bucket
        keys = np.concatenate([r[3].astype(np.uint64) | (np.repeat(np.arange(len(r[3]) // max(1, len(r[0])), dtype=np.uint64), len(r[0])) << np.uint64(32)) for r in read])
        rows = np.concatenate([np.tile(np.arange(e - len(r[0]), e), len(r[3]) // max(1, len(r[0]))) for r, e in zip(read, ends, strict=True)])
        order = np.argsort(keys, kind="stable")
        keys, rows = keys[order], rows[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[first, len(keys)])
        for f, size in zip(first[sizes > HOT], sizes[sizes > HOT], strict=True):
            cuts = [rows[f + k : min(f + k + HOT, f + size)] for k in range(0, size, HOT)]
            whole = [_packed(x[0][c], x[1][c], x[2][c], np.zeros(0, np.uint32)) for c in cuts]
            for i in range(len(cuts)):
                for j in range(i, len(cuts)):
                    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([whole[i]], pa.binary()), pa.array([whole[j]], pa.binary())], ["a", "b", "left", "right"])
        usual = np.repeat((sizes > 1) & (sizes <= HOT), sizes)
        keys, rows = keys[usual], rows[usual]
        # pairs of records at a distance of 1, 2, ... in the order of keys, as long as they share one
        at, step, out, waiting = np.arange(len(keys)), 1, [], 0
        while len(at):
            at = at[at + step < len(keys)]
            at = at[keys[at + step] == keys[at]]
            for k in range(0, len(at), 1_000_000):
                own = at[k : k + 1_000_000]
                i, j = _near(x, rows[own], x, rows[own + step], apart)
                if len(i):
                    out.append((x[0][i], x[0][j]))
                    waiting += len(i)
            if waiting > 500_000:
                yield found(*(np.concatenate(o) for o in zip(*out, strict=True)))
                out, waiting = [], 0
            step += 1
        if out:
            yield found(*(np.concatenate(o) for o in zip(*out, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for b in batches:
            for k, block in zip(b.column("bucket").to_pylist(), b.column("block").to_pylist(), strict=True):
                held.setdefault(k, []).append(block)
        while held:
            yield from bucket(held.popitem()[1])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for left, right in zip(b.column("left").to_pylist(), b.column("right").to_pylist(), strict=True):
                x, y = _unpacked(left), _unpacked(right)
                for k in range(len(x[0])):
                    i, j = _near(x, np.full(len(y[0]), k), y, np.arange(len(y[0])), apart)
                    if len(i):
                        yield found(x[0][i], y[0][j]).select(["a", "b"])

    cells = materialize(blocks.repartitionById(buckets, "bucket").mapInArrow(run, shape), "cells")
    pairs, hot = cells.where("left is null").select("a", "b"), cells.where("left is not null").select("left", "right")
    if hot.isEmpty():
        return pairs
    return pairs.unionByName(hot.repartition(buckets).mapInArrow(split, "a bigint, b bigint"))


class NearDuplicates:
    """Links between records of which no two are exact copies, and the copies of each.

    ``links`` has (a, b), a < b, of representatives; ``members`` (rep, id) of every record.
    """

    def __init__(self, records: DataFrame, row_id: str, fields: Sequence[str], similarity: float = 0.8):
        if not isinstance(records.schema[row_id].dataType, IntegralType):
            raise TypeError(f"{row_id} must be an integer")
        words = materialize(tokenized(records, row_id, fields), "words")
        bags = words.where("m > 0").select("id", F.xxhash64("words").alias("h1"), F.xxhash64(F.lit(5), "words").alias("h2"))
        groups = materialize(bags.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1"), "groups")
        copies = join_by_frequency(bags, groups, ["h1", "h2"], "n").select("rep", "id")
        self.copies = materialize(copies, "copies")
        extra = small_or_shuffled(self.copies.where("id <> rep").select("id"))
        single = words.join(extra, "id", "left_anti")
        n = words.count() - self.copies.where("id <> rep").count()
        blocks, buckets = keyed(single, n, similarity, records.sparkSession.sparkContext.defaultParallelism)
        pairs = materialize(candidates(blocks, buckets, similarity).distinct(), "candidates")
        wanted = materialize(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct(), "wanted")
        texts = words.join(small_or_shuffled(wanted), "id", "left_semi").select("id", "words")
        both = pairs.join(texts.select(F.col("id").alias("a"), F.col("words").alias("wa")), "a").join(texts.select(F.col("id").alias("b"), F.col("words").alias("wb")), "b")
        shared = F.size(F.array_intersect("wa", "wb"))
        self.links = materialize(both.where(2 * shared >= F.lit(similarity) * (F.size("wa") + F.size("wb")) - 1e-9).select("a", "b"), "links")
        self.ids = records.select(F.col(row_id).alias("id"))

    def pairs(self) -> DataFrame:
        """(a, b), a < b, of every pair of records, copies included.

        The copies of a record are parted into blocks of about ``HOT``, so no task gets all pairs of a large group.
        """
        sizes = self.copies.groupBy("rep").agg(F.ceil(F.count("*") / HOT).cast("int").alias("blocks"))
        parted = self.copies.where("id <> rep").join(small_or_shuffled(materialize(sizes.where("blocks > 1"), "sizes")), "rep", "left").fillna(1, ["blocks"])
        of = parted.unionByName(parted.select("rep", F.col("rep").alias("id"), "blocks").distinct()).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        left = of.select("rep", F.col("id").alias("a"), F.col("block").alias("i"), every.alias("j"))
        right = of.select("rep", F.col("id").alias("b"), F.col("block").alias("j"), every.alias("i"))
        within = left.join(right, ["rep", "i", "j"]).where("a < b").select("a", "b")
        spread = self.links
        for side in "ab":
            more = of.select(F.col("rep").alias(side), F.col("id").alias("copy"), "block")
            ends = spread.join(of.select(F.col("rep").alias(side), "blocks").distinct(), side, "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
            spread = ends.join(more, [side, "block"], "left").where("copy is not null or blocks is null").withColumn(side, F.coalesce("copy", side)).select("a", "b")
        return within.unionByName(spread.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))

    def groups(self) -> DataFrame:
        """(id, group_id, n_links) of every record: the smallest id that a chain of links leads to, and the number of other records it resembles."""
        links = self.links.unionByName(self.copies.where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b")))
        labels = components(links)
        sizes = self.copies.groupBy("rep").agg(F.count("*").alias("n"))
        ends = self.links.unionByName(self.links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        linked = ends.join(sizes.withColumnRenamed("rep", "b"), "b", "left").groupBy(F.col("a").alias("rep")).agg(F.sum(F.coalesce("n", F.lit(1))).alias("others"))
        whole = self.ids.join(labels, "id", "left").join(self.copies, "id", "left").withColumn("rep", F.coalesce("rep", "id"))
        whole = whole.join(sizes, "rep", "left").join(linked, "rep", "left")
        return whole.select("id", F.coalesce("label", "id").alias("group_id"), (F.coalesce("others", F.lit(0)) + F.coalesce("n", F.lit(1)) - 1).alias("n_links"))


def components(links: DataFrame) -> DataFrame:
    """(id, label) of every id in ``links`` (a, b): the smallest id of its connected component.

    Alternates large-star and small-star steps, each of which is one aggregation, until nothing changes.
    """
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("low").alias("v")), F.struct(F.col("v").alias("u"), F.col("low").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        small = materialize(small, "edges")
        same = edges.exceptAll(small).isEmpty() and small.exceptAll(edges).isEmpty()
        edges = small
        if same:
            break
    labels = edges.select(F.col("u").alias("id"), F.col("v").alias("label"))
    return labels.unionByName(labels.select(F.col("label").alias("id"), "label").distinct())
