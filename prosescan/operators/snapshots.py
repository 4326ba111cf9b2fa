"""What changed between full snapshots of a table, from validity intervals.

Every row of a snapshot is reduced to its key, its position among the group's snapshots and a
128-bit row hash. Gaps and islands over positions and hashes give the intervals in which a key
stood unchanged. Where an interval starts without another that ends just before, the key was
added; where one ends without another that starts just after, it was removed; where one follows
the other, it changed.

Islands are formed within blocks of positions and adjacent intervals meet in an aggregation by
(group, key, position), so no task depends on how many snapshots or rows one key has.

Defined results: rows with a null group or snapshot belong to no snapshot and are dropped; a
null key is a key; a null value differs from every text and equals null; of repeated rows the
one loaded last counts, of several loaded last the one with the greatest value, null below all;
snapshots with the same time follow each other by name; the first snapshot and an empty table
yield no events.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prosescan.functions.scratch import materialize, small_or_shuffled

#: Positions that one island task gets of one key.
BLOCK = 4096


def validity_intervals(rows: DataFrame, group: str, snapshot: str, taken_at: str, key: str, values: Sequence[str], loaded_at: str, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Intervals (group, key, first, last, h1, h2) of unchanged ``values``, cut at block borders; and
    the snapshots (group, snapshot, position, n_snapshots), positions from 1 in order of ``taken_at``.

    String values are compared without spaces at their ends.
    """
    kinds = dict(rows.dtypes)
    held = F.struct(*[(F.trim(F.col(v)) if kinds[v] == "string" else F.col(v)).alias(f"v{i}") for i, v in enumerate(values)])
    rows = rows.select(F.col(group).alias("grp"), F.col(snapshot).alias("snap"), F.col(taken_at).alias("taken"), F.col(key).alias("key"), held.alias("held"), F.col(loaded_at).alias("loaded")).where("grp is not null and snap is not null")
    snaps = rows.groupBy("grp", "snap").agg(F.min("taken").alias("taken"))
    by_time = Window.partitionBy("grp").orderBy("taken", "snap")
    snaps = snaps.select("grp", "snap", F.row_number().over(by_time).alias("pos"), F.count("*").over(Window.partitionBy("grp")).cast("int").alias("n_snaps"))
    snaps = materialize(snaps, "snaps")
    # a literal makes the hash of a null differ from the hash of an empty text
    marks = [x for i in range(len(values)) for x in (F.col(f"held.v{i}").isNull(), F.col(f"held.v{i}"))]
    lean = rows.select("grp", "snap", "key", F.struct("loaded", "held").alias("version"))
    last = lean.groupBy("grp", "snap", "key").agg(F.max("version.loaded").alias("loaded"), F.max("version").alias("version")).select("grp", "snap", "key", F.col("version.held").alias("held"))
    last = last.select("grp", "snap", "key", F.xxhash64(*marks).alias("h1"), F.xxhash64(F.lit(7), *marks, F.lit(11)).alias("h2"))
    placed = last.join(small_or_shuffled(snaps.select("grp", "snap", "pos")), ["grp", "snap"]).drop("snap")
    w = Window.partitionBy("grp", "key", F.floor(F.col("pos") / block)).orderBy("pos")
    same = (F.lag("pos").over(w) == F.col("pos") - 1) & (F.lag("h1").over(w) == F.col("h1")) & (F.lag("h2").over(w) == F.col("h2"))
    starts = placed.withColumn("starts", F.coalesce(same, F.lit(False)) == F.lit(False))
    # the row after the last of an island starts the next one, so two neighbours of the starting rows give an island's ends
    island = F.sum(F.col("starts").cast("int")).over(w)
    islands = starts.withColumn("island", island).withColumn("blk", F.floor(F.col("pos") / block))
    spans = islands.groupBy("grp", "key", "blk", "island").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.first("h1").alias("h1"), F.first("h2").alias("h2"))
    return spans.select("grp", "key", "first", "last", "h1", "h2"), snaps


def snapshot_changes(rows: DataFrame, group: str, snapshot: str, taken_at: str, key: str, values: Sequence[str], loaded_at: str, block: int = BLOCK) -> DataFrame:
    """(group, snapshot, key, change_kind): 'added', 'removed' or 'changed' from each snapshot of a group to its next.

    ``snapshot`` is the later one of the two.
    """
    spans, snaps = validity_intervals(rows, group, snapshot, taken_at, key, values, loaded_at, block)
    side = lambda at, opens: spans.select("grp", "key", at.alias("pos"), F.lit(opens).alias("opens"), "h1", "h2")
    edges = side(F.col("first"), True).unionByName(side(F.col("last") + 1, False))
    of = lambda h, opens: F.max(F.when(F.col("opens") == F.lit(opens), F.col(h)))
    met = edges.groupBy("grp", "key", "pos").agg(of("h1", True).alias("a1"), of("h2", True).alias("a2"), of("h1", False).alias("b1"), of("h2", False).alias("b2"))
    kind = F.when(F.col("b1").isNull(), "added").when(F.col("a1").isNull(), "removed").when((F.col("a1") != F.col("b1")) | (F.col("a2") != F.col("b2")), "changed")
    events = met.where("pos > 1").withColumn("change_kind", kind).where("change_kind is not null")
    named = events.join(small_or_shuffled(snaps.select("grp", "pos", "snap")), ["grp", "pos"])
    return named.select(F.col("grp").alias(group), F.col("snap").alias(snapshot), F.col("key").alias(key), "change_kind")
