from datetime import datetime, timedelta

from prosescan.operators import snapshots

SCHEMA = "g string, s string, at timestamp, k string, title string, n int, loaded timestamp, pos string"
T0 = datetime(2031, 1, 1)


def changes(spark, rows, values=("title",), block=4096):
    data = [(g, s, T0 + timedelta(days=d), k, title, n, T0 + timedelta(hours=h), "clash") for g, s, d, k, title, n, h in rows]
    got = snapshots.snapshot_changes(spark.createDataFrame(data, SCHEMA), "g", "s", "at", "k", list(values), "loaded", block)
    return sorted((tuple(r) for r in got.collect()), key=str)


def brute(rows):
    """Change events by comparing each snapshot with the next."""
    held, when = {}, {}
    for g, s, d, k, title, _, h in rows:
        when[g, s] = min(d, when.get((g, s), d))
        key = (g, s, k)
        new = (h, title is not None, title or "")
        if key not in held or new > held[key]:
            held[key] = new
    out = []
    for g in {x for x, _ in when}:
        order = sorted((d, s) for (x, s), d in when.items() if x == g)
        for (_, a), (_, b) in zip(order, order[1:], strict=False):
            old = {k: v[1:] for (x, s, k), v in held.items() if (x, s) == (g, a)}
            new = {k: v[1:] for (x, s, k), v in held.items() if (x, s) == (g, b)}
            strip = lambda v: (v[0], v[1].strip(" "))
            out += [(g, b, k, "added") for k in new.keys() - old.keys()] + [(g, b, k, "removed") for k in old.keys() - new.keys()]
            out += [(g, b, k, "changed") for k in new.keys() & old.keys() if strip(old[k]) != strip(new[k])]
    return sorted(out, key=str)


def test_events_equal_brute_force_for_any_block(spark):
    import random

    rng = random.Random(3)
    rows = []
    for g in "xyz":
        for d in range(9):
            if rng.random() < 0.2:
                continue
            for k in range(6):
                if rng.random() < 0.7:
                    row = (g, f"{g}{d}", d, f"k{k}", rng.choice(["A", " A ", "B", None, "", "a"]), k, d * 24 + 1)
                    rows += [row] * rng.choice([1, 1, 2])
                    if rng.random() < 0.2:
                        rows.append((*row[:4], rng.choice(["C", None]), k, d * 24 + 9))
    want = brute(rows)
    assert want
    for block in (1, 2, 4096):
        assert changes(spark, rows, block=block) == want


def test_returns_ties_and_nulls(spark):
    rows = [("g", "a", 0, "k", "T", 1, 1), ("g", "b", 1, "x", "T", 1, 1), ("g", "c", 2, "k", "T", 1, 1), (None, "c", 2, "k", "T", 1, 1), ("g", None, 2, "k", "T", 1, 1)]
    assert changes(spark, rows) == sorted([("g", "b", "k", "removed"), ("g", "b", "x", "added"), ("g", "c", "k", "added"), ("g", "c", "x", "removed")], key=str)
    # two rows loaded at once: the greater value counts, null below all
    rows = [("g", "a", 0, "k", None, 1, 1), ("g", "a", 0, "k", "Z", 1, 1), ("g", "b", 1, "k", "Z", 1, 1)]
    assert changes(spark, rows) == []


def test_several_values_and_a_null_key(spark):
    rows = [("g", "a", 0, None, "T", 1, 1), ("g", "b", 1, None, "T", 2, 1)]
    assert changes(spark, rows) == [] and changes(spark, rows, ("title", "n")) == [("g", "b", None, "changed")]


def test_one_snapshot_and_none(spark):
    assert changes(spark, [("g", "a", 0, "k", "T", 1, 1)]) == []
    assert changes(spark, []) == []
