from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from prosescan.operators import hierarchy

SCHEMA = "name string, derived_from array<string>, external_ancestors array<string>, ancestor string"


def brute(links):
    up = defaultdict(set)
    for parent, child in links:
        up[child].add(parent)
    out = {}
    for name in list(up):
        level, seen, d = {name}, {}, 0
        while level:
            d += 1
            level = {p for n in level for p in up[n]} - set(seen)
            seen |= dict.fromkeys(level, d)
        out |= {(a, name): k for a, k in seen.items()}
    return out


def closed(spark, links, per_split=50_000):
    df = spark.createDataFrame(links, "parent string, child string")
    return {(r.ancestor, r.name): r.distance for r in hierarchy.closure(df, per_split).collect()}


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.tuples(st.sampled_from("abcdefg"), st.sampled_from("abcdefg")), min_size=1, max_size=10))
def test_closure_equals_brute_force(spark, links):
    assert closed(spark, sorted(links)) == brute(links)


def test_circles_diamonds_and_split_parents(spark):
    links = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("r", "x"), ("r", "y"), ("x", "z"), ("y", "z"), ("z", "w"), ("s", "s"), *[("r", f"k{i}") for i in range(30)]]
    for per_split in (4, 50_000):
        got = closed(spark, links, per_split)
        assert got == brute(links)
    assert got["a", "a"] == 3 and got["s", "s"] == 1 and got["r", "w"] == 3


def test_dirty_names(spark):
    rows = [
        (" Kid ", ["MUM", " mum ", None, "", "  "], None, "clash"), (" Kid ", ["MUM", " mum ", None, "", "  "], None, "clash"), ("mum", None, ["Gran (an idea (old) only)", "(remark)"], None),
        (None, ["mum"], [], None), ("", ["mum"], [], None), ("alone", [], None, None), ("back", None, ["alone (by way of a fork) "], None),
    ]
    names, links = hierarchy.names_and_links(spark.createDataFrame(rows, SCHEMA))
    assert {tuple(r) for r in links.collect()} == {("mum", "kid"), ("gran", "mum"), ("alone", "back")}
    got = {r.name: r for r in hierarchy.resolve(names, links).collect()}
    assert got["kid"].path == ["gran", "mum", "kid"] and got["kid"].depth == 2 and got["kid"].root == "gran"
    assert got["gran"].n_descendants == 2 and got["alone"].depth == 0 and not got["kid"].on_circle


def test_unreached_names_and_ties(spark):
    rows = [("a", ["b"], None, None), ("b", ["a"], None, None), ("c", ["b"], None, None), ("t", ["y", "x"], None, None), ("x", ["r"], None, None), ("y", ["r"], None, None)]
    got = {r.name: r for r in hierarchy.resolve(*hierarchy.names_and_links(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got["c"].path is None and not got["c"].on_circle and got["a"].on_circle and got["c"].n_ancestors == 2
    assert got["t"].path == ["r", "x", "t"]


def test_all_roots_and_paths(spark, tmp_path):
    from prosescan.plans import pipeline

    rows = [("r", None, None, None), ("q", None, None, None), ("x", ["r", "q"], None, None), ("t", ["x", "r"], None, None), ("a", ["b"], None, None), ("b", ["a"], None, None), ("c", ["b", "x"], None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/manifest.parquet")
    roots = [tuple(r) for r in pipeline.QUERIES["p1_roots"](spark, str(tmp_path)).collect()]
    assert sorted(roots) == [("c", "q", 2), ("c", "r", 2), ("q", "q", 0), ("r", "r", 0), ("t", "q", 2), ("t", "r", 1), ("x", "q", 1), ("x", "r", 1)]
    paths = [tuple(r) for r in pipeline.QUERIES["p1_paths"](spark, str(tmp_path)).collect()]
    x, circle = [("q", "x"), ("r", "x")], [("a", "b"), ("b", "a")]
    want = {"x": x, "t": [*x, ("x", "t"), ("r", "t")], "a": circle, "b": circle, "c": [*x, *circle, ("b", "c"), ("x", "c")]}
    assert sorted(paths) == sorted((name, *link) for name, links in want.items() for link in links)


def test_empty_table(spark):
    names, links = hierarchy.names_and_links(spark.createDataFrame([], SCHEMA))
    assert hierarchy.closure(links).count() == 0 and hierarchy.resolve(names, links).count() == 0


def test_long_chain_keeps_one_plan_per_level(spark):
    links = [(f"n{i:03}", f"n{i + 1:03}") for i in range(25)]
    got = closed(spark, links)
    assert len(got) == 25 * 26 // 2 and got["n000", "n025"] == 25


def test_scratch_needs_a_shared_folder_on_a_cluster(spark):
    from prosescan.functions import scratch

    assert scratch.scratch_dir(spark) == (spark.conf.get("spark.checkpoint.dir", None) or scratch.scratch_dir(spark))

    class Elsewhere:
        class sparkContext:
            master = "spark://host:7077"

        class conf:
            get = staticmethod(lambda *_: None)

    with pytest.raises(RuntimeError):
        scratch.scratch_dir(Elsewhere())
