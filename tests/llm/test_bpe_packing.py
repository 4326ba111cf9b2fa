import base64
import random

import pytest

pytest.importorskip("public_tokenizers")
import public_tokenizers
import tiktoken

from prosescan.llm import bpe, packing

HARD = [
    None, "", " ", "a", "Hello, World!", "don't  stop\n\n\tnow   ", "naïve café 你好，世界 😂👩‍💻", "<|endoftext|> is text", "a" * 20_000, "ab" * 5000, "xyzzyq" * 3000, "1234567890" * 300,
    "\u0000​﻿ ", "ＡＢＣ　ｄｅｆ", "é" * 999, "é" * 999, "   x" * 500, "'ll've're'd'S'T", "\r\n\r\n a\r\nb", "ﬁancé" * 7,
]


@pytest.fixture(scope="module")
def reference():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_the_public_encoder(reference):
    own = bpe.Encoder(bpe.vocabulary_path("byte_bpe_50k.json"))
    rng = random.Random(1)
    texts = HARD + ["".join(rng.choice("abc de'fghij 123 ßéñ你好。!?\n\t") for _ in range(rng.randrange(200))) for _ in range(300)]
    assert own.encode(texts) == [reference.encode_ordinary(t) if t else [] for t in texts]


def test_round_trip_of_random_bytes(reference):
    own = bpe.Encoder(bpe.vocabulary_path("byte_bpe_50k.json"))
    rng = random.Random(2)
    texts = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0xD7FF), rng.randrange(0x10000, 0x1FFFF)])) for _ in range(60)) for _ in range(80)]
    assert [reference.decode(ids) for ids in own.encode(texts)] == texts


def test_columns(spark, reference):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(HARD)] + [(99, HARD[4], "clash")], "doc_id long, text string, ids string")
    got = {r.doc_id: list(r.ids) for r in bpe.encode_column(df, "doc_id", "text").collect()}
    assert got == {i: reference.encode_ordinary(t) if t else [] for i, t in [*enumerate(HARD), (99, HARD[4])]}
    assert {r.doc_id: r.n_tokens for r in bpe.token_counts(df, "doc_id", "text").collect()} == {i: len(x) for i, x in got.items()}
    assert bpe.encode_column(df.limit(0), "doc_id", "text").count() == 0


def test_closest_filling_equals_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        counts = {rng.randrange(1, 12): rng.randrange(1, 4) for _ in range(5)}
        room = rng.randrange(0, 25)
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * i for s in sums for i in range(n + 1)}
        used = packing.closest_filling(counts, room)
        assert sum(k * n for k, n in used.items()) == max(s for s in sums if s <= room)
        assert all(n <= counts[k] for k, n in used.items())


def packed(spark, sizes, capacity):
    df = spark.createDataFrame([(i, s, 7) for i, s in enumerate(sizes)], "doc_id long, n int, piece int")
    rows = packing.pack(df, "doc_id", "n", capacity).collect()
    of = {}
    for r in rows:
        of.setdefault(r.doc_id, []).append(r)
    assert set(of) == set(range(len(sizes)))
    for i, s in enumerate(sizes):
        pieces = sorted(of[i], key=lambda r: r.piece)
        assert sum(r.n_tokens for r in pieces) == (s or 0) and len(pieces) == max(1, -(-(s or 0) // capacity))
        assert [r.piece_start for r in pieces] == [k * capacity for k in range(len(pieces))]
    boxes = {}
    for r in rows:
        boxes.setdefault(r.container_id, []).append((r.container_offset, r.n_tokens))
    for spans in boxes.values():
        at = 0
        for offset, n in sorted(x for x in spans if x[1]):
            assert offset == at
            at += n
        assert at <= capacity
    return rows, len(boxes)


def test_packing_keeps_every_item_whole(spark):
    rng = random.Random(5)
    sizes = [rng.randrange(0, 130) for _ in range(700)] + [64] * 300 + [0, None, 1000, 200, 100]
    rows, _ = packed(spark, sizes, 100)
    again, _ = packed(spark, sizes, 100)
    assert sorted(rows) == sorted(again)


def test_packing_fills(spark):
    rng = random.Random(6)
    sizes = [min(2048, int(rng.lognormvariate(5, 1)) + 1) for _ in range(3000)]
    _, boxes = packed(spark, sizes, 2048)
    assert sum(sizes) / (boxes * 2048) > 0.995


def test_nothing_to_pack(spark):
    assert packed(spark, [], 10) == ([], 0)
    rows, boxes = packed(spark, [0, None], 10)
    assert boxes == 1 and len(rows) == 2
