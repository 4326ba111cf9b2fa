import random
import re
from collections import Counter

from pyspark.sql import functions as F

from prosescan.llm import formatdup, neardup

FIELDS = ["signature", "description", "guidance"]
SCHEMA = "rule_id long, signature string, description string, guidance string, id string, words string"


def brute(rows, least=0.8):
    bags = {r[0]: Counter(w for w in re.split(r"[\W_]+", " ".join(x or "" for x in r[1:4]).lower()) if w) for r in rows}
    out = set()
    for a in bags:
        for b in bags:
            m, n = sum(bags[a].values()), sum(bags[b].values())
            if a < b and m + n and 2 * sum((bags[a] & bags[b]).values()) >= least * (m + n):
                out.add((a, b))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


def sample(rng, n, vocabulary=1500):
    words = [f"w{i}" for i in range(vocabulary)]
    rows = []
    for i in range(n):
        rows.append((i, "a.b_c", "The " + " ".join(rng.choices(words, k=20)), " ".join(rng.choices(words, k=45)) + " and the rest."))
        if rng.random() < 0.5:
            text = rows[-1][3].split()
            for _ in range(rng.randrange(0, 8)):
                text[rng.randrange(len(text))] = rng.choice([*words[:50], "typo", "X1"])
            rng.shuffle(text)
            rows.append((10_000 + i, "A.B-C", rows[-1][2].upper(), " ".join(text)))
    return rows


def test_pairs_equal_brute_force(spark):
    rng = random.Random(7)
    rows = sample(rng, 250)
    rows += [(50_000 + i, *rows[0][1:]) for i in range(4)]
    rows += [(60_000, None, None, None), (60_001, "", "!!!", None), (60_002, "one", None, None), (60_003, "ONE!", None, None), (60_004, "x" * 5, "long " * 30_000, None), (60_005, None, "long " * 30_001, "y")]
    found = neardup.NearDuplicates(frame(spark, rows), "rule_id", FIELDS)
    assert {tuple(r) for r in found.pairs().collect()} == brute(rows)
    want = brute(rows)
    group = {r[0]: r[0] for r in rows}
    for _ in range(8):
        for a, b in want:
            group[a] = group[b] = min(group[a], group[b])
    links = Counter(x for p in want for x in p)
    assert {r.id: (r.group_id, r.n_links) for r in found.groups().collect()} == {i: (g, links[i]) for i, g in group.items()}


def test_a_hot_cluster_loses_no_link(spark):
    rng = random.Random(8)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(60):
        text = list(base)
        for _ in range(3):
            text[rng.randrange(60)] = f"e{rng.randrange(9999)}"
        rows.append((i, None, " ".join(text), None))
    rows += [(1000 + r[0], *r[1:]) for r in sample(rng, 60)]
    found = neardup.NearDuplicates(frame(spark, rows), "rule_id", FIELDS)
    assert {tuple(r) for r in found.pairs().collect()} == brute(rows)


def test_edits_on_uncommon_words_only_lose_no_pair(spark):
    rng = random.Random(9)
    common = [f"c{i}" for i in range(48)]
    rows = []
    for i in range(150):
        own = [f"r{i}x{k}" for k in range(27)]
        other = [f"s{i}x{k}" for k in range(15)] + own[15:]
        for j, text in ((i, common + own), (1000 + i, common + other)):
            rng.shuffle(text)
            rows.append((j, None, " ".join(text), None))
    rows += [(5000 + r[0], *r[1:]) for r in sample(rng, 200)]
    found = neardup.NearDuplicates(frame(spark, rows), "rule_id", FIELDS)
    want = brute(rows)
    assert {(i, 1000 + i) for i in range(150)} <= want
    assert {tuple(r) for r in found.pairs().collect()} == want


def test_hot_cells_and_hot_copies_are_split(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HOT", 16)
    monkeypatch.setattr(neardup, "BUCKET_KEYS", 100)
    rng = random.Random(10)
    base = [f"b{i}" for i in range(60)]
    rows = [(i, None, " ".join([*base[: i % 60], f"e{i}", *base[i % 60 + 1 :]]), None) for i in range(120)]
    rows += [(2000 + i, *rows[3][1:]) for i in range(70)] + [(5000 + r[0], *r[1:]) for r in sample(rng, 60)]
    found = neardup.NearDuplicates(frame(spark, rows), "rule_id", FIELDS)
    got = [tuple(r) for r in found.pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_layouts_miss_at_most_what_they_say():
    for n in (1, 1000, 10**6, 10**9):
        coordinates, many = neardup.layouts(n, 0.8)
        assert (1 - (2 / 3) ** coordinates) ** many <= neardup.MISS and coordinates >= neardup.LEAST_COORDINATES


def test_no_rows(spark):
    found = neardup.NearDuplicates(frame(spark, []), "rule_id", FIELDS)
    assert found.pairs().count() == 0 and found.groups().count() == 0


def test_the_distance_of_embeddings_is_a_lower_bound():
    import numpy as np

    rng = np.random.default_rng(3)
    for n, same in ((40, 25), (300, 290), (5, 0)):
        a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) for _ in range(2))
        b[:same] = a[:same]
        x, y = (neardup._embedded(v, np.zeros(n, np.int64), 1) for v in (a, b))
        got = int(np.bitwise_count(x ^ y).sum())
        assert (0 < got if n < 200 else 0 <= got) and got <= 2 * (n - same)


RAW = [
    (1, '{"text":"Deep - dive","kind":"literal","match":"deep dive"}'), (2, '{ "match" : "DEEP  dive." , "kind":"Literal", "text":"deep dive!", "note": "" }'), (3, '{"note":null,"text":"deepdive","kind":"literal","match":"deep dive"}'),
    (4, '{"text":"dive deep","kind":"literal","match":"deep dive"}'), (5, '{"text":"deep dive","kind":"literal","match":"deep dive","note":"see 2"}'), (6, '{"text":"deep dive","kind":"literal","match":"deep dive","note":"see 3"}'),
    (7, '{"text":"na\\u00efve","kind":"a","match":"x"}'), (8, '{"text":"nai\\u0308ve","kind":"A","match":"X"}'), (9, '{"text":"naive","kind":"a","match":"x"}'), (10, None), (11, "no json"), (12, "[1]"), (13, "{}"), (14, '{"other":1}'),
    (15, '{"text":"deep dive","kind":"literal","match":"deep dive","note":"—"}'), (16, '{"text":"' + "z " * 60_000 + '","kind":"k","match":"m"}'), (17, '{"text":"' + "Z" * 60_000 + '","kind":"k","match":"m"}'),
]
PAYLOAD = ["text", "kind", "match", "note"]


def records(spark, rows):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "raw_id long, payload string, codes string, keep_id string")
    return df.select("raw_id", formatdup.json_fields(F.col("payload"), PAYLOAD).alias("f")).where("f is not null").select("raw_id", "f.*")


def test_format_duplicates(spark):
    got = sorted(tuple(r) for r in formatdup.format_duplicates(records(spark, RAW), "raw_id", PAYLOAD).collect())
    assert got == [(1, 2), (1, 3), (1, 15), (7, 8), (13, 14), (16, 17)]
    kept = {r.keep_id: (r.text, r.n_copies) for r in formatdup.collapsed(records(spark, RAW), "raw_id", PAYLOAD).collect()}
    assert kept[1] == ("Deep - dive", 4) and kept[9] == ("naive", 1) and set(kept) == {1, 4, 5, 6, 7, 9, 13, 16}


def test_a_hot_record_and_no_record(spark):
    rows = [(i, '{"text":"' + " " * (i % 3) + 'hot","kind":"literal","match":"hot"}') for i in range(3000)] + [(5000 + i, f'{{"text":"t{i}","kind":"literal","match":"m"}}') for i in range(2000)]
    got = formatdup.format_duplicates(records(spark, rows), "raw_id", PAYLOAD)
    assert got.count() == 2999 and {r.keep_id for r in got.select("keep_id").distinct().collect()} == {0}
    assert formatdup.format_duplicates(records(spark, []), "raw_id", PAYLOAD).count() == 0
