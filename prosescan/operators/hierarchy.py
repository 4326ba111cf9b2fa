"""Parent-child links of unknown depth, resolved to full hierarchies.

A frontier of ancestor pairs starts from all links. Each round joins the pairs of the last complete
level k with all pairs of the levels up to k, which gives the levels k + 1 to 2k: a shortest path of
that length has a shortest path of k links as its first part. So a chain of n links takes log n
rounds, each pair is found once per way, and a pair found before keeps its smaller distance. A pair
that comes back to its ancestor closes a circle and isn't extended. Paths and depths come from a
second frontier, which goes level by level from the roots; names it never reaches hang below a
circle. A name with many descendants is split, and the pairs above it go to each of its parts.

Defined results: a null or blank name or parent is no name, and its link is dropped; repeated
rows and repeated parents count once; a parent without a row is a name like any other; an empty
table has no names. Ties between shortest paths go to the smallest path in code-point order.
Columns other than the ones named are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosescan.functions.scratch import Levels, materialize, small_or_shuffled, trimmed

#: Children of one parent that one join task gets; a parent with more is split.
CHILDREN_PER_SPLIT = 50_000

REMARK = r"\s*[(（](?:[^()（）]|[(（][^()（）]*[)）])*[)）]\s*\z"


def clean_name(name: Column, remarks: bool = False) -> Column:
    """Lower case, without blanks at the ends and, for ``remarks``, without a closing remark in parentheses; null if nothing is left."""
    name = trimmed(name)
    if remarks:
        name = trimmed(F.regexp_replace(name, REMARK, ""))
    return F.nullif(F.lower(name), F.lit(""))


def names_and_links(table: DataFrame, name: str = "name", parents: Sequence[str] = ("derived_from",), remarked: Sequence[str] = ("external_ancestors",)) -> tuple[DataFrame, DataFrame]:
    """(name) of every row and parent, and the distinct links (parent, child).

    ``parents`` and ``remarked`` are array columns; entries of the latter may close with a remark.
    """
    lists = [F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), clean) for cs, clean in ((parents, lambda x: clean_name(x)), (remarked, lambda x: clean_name(x, True))) for c in cs]
    rows = table.select(clean_name(F.col(name)).alias("child"), F.array_distinct(F.flatten(F.array(*lists))).alias("parents")).where("child is not null")
    links = rows.select(F.explode("parents").alias("parent"), "child").where("parent is not null").distinct()
    names = rows.select(F.col("child").alias("name"))
    return names, links


def prepared(links: DataFrame, per_split: int = CHILDREN_PER_SPLIT) -> tuple[DataFrame, DataFrame | None]:
    """Links with ``only`` (the child has no other parent) and ``part``; and the parents that are split, if any.

    Fewer than links/per_split parents are split, so that table may be broadcast.
    """
    links = materialize(links, "links")
    counts = links.groupBy("child").agg((F.count("*") == 1).alias("only"))
    large = materialize(links.groupBy("parent").agg(F.ceil(F.count("*") / per_split).cast("int").alias("parts")).where("parts > 1"), "large")
    whole = links.join(counts, "child").join(F.broadcast(large), "parent", "left")
    whole = whole.select("parent", "child", "only", F.coalesce(F.pmod(F.xxhash64("child"), F.col("parts")), F.lit(0)).cast("int").alias("part"))
    return materialize(whole, "links"), None if large.isEmpty() else large


def _children(frontier: DataFrame, links: DataFrame, large: DataFrame | None) -> DataFrame:
    """Frontier rows joined with the links below their ``name``; a split parent's row goes to each of its parts."""
    spread = frontier.withColumnRenamed("name", "parent")
    if large is None:
        return spread.join(links.drop("part"), "parent")
    spread = spread.join(F.broadcast(large), "parent", "left")
    spread = spread.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1))).drop("parts")
    return spread.join(links, ["parent", "part"])


def closure(links: DataFrame, per_split: int = CHILDREN_PER_SPLIT) -> DataFrame:
    """(ancestor, name, distance) for every pair connected by one or more of the links (parent, child).

    ``distance`` is the fewest links between them; a name on a circle is its own ancestor.
    """
    spark = links.sparkSession
    shape = ("ancestor", "name", "distance")
    first = links.select(F.col("parent").alias("ancestor"), F.col("child").alias("name"), F.lit(1).alias("distance")).distinct()
    levels, reach = Levels(spark, "pairs"), 1
    level, going = levels.add(first, F.col("ancestor") != F.col("name"))
    while going:
        known = levels.read()
        open_ = known.where("ancestor <> name")
        frontier = open_.where(F.col("distance") == reach).select("ancestor", F.col("name").alias("mid"), F.col("distance").alias("so_far"))
        below = open_.select(F.col("ancestor").alias("mid"), "name", "distance")
        large = below.groupBy("mid").agg(F.ceil(F.count("*") / per_split).cast("int").alias("parts")).where("parts > 1")
        large = F.broadcast(materialize(large, "large"))
        split = lambda rows, own: rows.join(large, "mid", "left").withColumn("part", own).drop("parts")  # noqa: B023, E731
        every = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
        below = split(below, F.coalesce(F.pmod(F.xxhash64("name"), F.col("parts")), F.lit(0)).cast("int"))
        found = split(frontier, every).join(below, ["mid", "part"]).groupBy("ancestor", "name").agg(F.min(F.col("so_far") + F.col("distance")).alias("distance"))
        fresh = found.join(known.select("ancestor", "name"), ["ancestor", "name"], "left_anti").select(*shape)
        reach *= 2
        # the next round starts from the pairs at the greatest distance this one can reach
        level, going = levels.add(fresh, (F.col("distance") == reach) & (F.col("ancestor") != F.col("name")))
    return levels.read().select(*shape)


def root_paths(names: DataFrame, links: DataFrame, per_split: int = CHILDREN_PER_SPLIT) -> DataFrame:
    """(name, root, depth, path) of every name that a root reaches, by the shortest path from a root.

    A root has no parent. Names without a row here lie on a circle or only below one. A name with one parent is
    reached once; only names with several are compared with those reached before.
    """
    links, large = prepared(links, per_split)
    every = names.select("name").union(links.select("parent")).union(links.select("child")).distinct()
    roots = every.join(links.select(F.col("child").alias("name")).distinct(), "name", "left_anti")
    levels, several = Levels(links.sparkSession, "paths"), Levels(links.sparkSession, "several")
    level, _ = levels.add(roots.select("name", F.array("name").alias("path")))
    several.schema = level.schema if level is not None else roots.select("name", F.array("name").alias("path")).schema
    forked = links.where("not only").limit(1).count()
    again = None
    while level is not None or again is not None:
        frontier = reduce(DataFrame.unionByName, [x for x in (level, again) if x is not None])
        below = lambda rows: _children(frontier, rows, large).select(F.col("child").alias("name"), F.array_append("path", F.col("child")).alias("path"))  # noqa: B023, E731
        level, _ = levels.add(below(links.where("only")))
        if forked:
            found = below(links.where("not only")).groupBy("name").agg(F.min("path").alias("path"))
            again, _ = several.add(found.join(several.read().select("name"), "name", "left_anti"))
    return levels.read().unionByName(several.read()).select("name", F.col("path")[0].alias("root"), (F.size("path") - 1).alias("depth"), "path")


def resolve(names: DataFrame, links: DataFrame, per_split: int = CHILDREN_PER_SPLIT) -> DataFrame:
    """One row per name: root, depth and path of one shortest way from a root (null if none leads
    to it; ``all_roots`` and ``path_links`` have the others), numbers of ancestors, descendants and roots, and whether it lies on a circle.
    """
    links = materialize(links, "links")
    every = names.select("name").union(links.select("parent")).union(links.select("child")).distinct()
    paths = root_paths(names, links, per_split)
    pairs = materialize(closure(links, per_split), "closure")
    roots = materialize(paths.where("depth = 0").select(F.col("name").alias("ancestor"), F.lit(1).alias("is_root")), "roots")
    up = pairs.join(small_or_shuffled(roots), "ancestor", "left").groupBy("name").agg(F.count_if(F.col("ancestor") != F.col("name")).alias("n_ancestors"), F.count("is_root").alias("n_roots"), F.bool_or(F.col("ancestor") == F.col("name")).alias("on_circle"))
    down = pairs.where("ancestor <> name").groupBy(F.col("ancestor").alias("name")).agg(F.count("*").alias("n_descendants"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    return every.join(paths, "name", "left").join(up, "name", "left").join(down, "name", "left").select("name", "root", "depth", "path", zero("n_ancestors"), zero("n_descendants"), zero("n_roots"), F.coalesce("on_circle", F.lit(False)).alias("on_circle"))


def all_roots(names: DataFrame, links: DataFrame, per_split: int = CHILDREN_PER_SPLIT) -> DataFrame:
    """(name, root, distance) of every name and each of its roots, with the fewest links between them; a root is its own at distance 0.

    Names that only circles lead to have no row.
    """
    links = materialize(links, "links")
    every = names.select("name").union(links.select("parent")).union(links.select("child")).distinct()
    roots = materialize(every.join(links.select(F.col("child").alias("name")).distinct(), "name", "left_anti"), "roots")
    below = closure(links, per_split).withColumnRenamed("ancestor", "root").join(small_or_shuffled(roots.withColumnRenamed("name", "root")), "root")
    return below.select("name", "root", "distance").unionByName(roots.select("name", F.col("name").alias("root"), F.lit(0).alias("distance")))


def path_links(links: DataFrame, per_split: int = CHILDREN_PER_SPLIT) -> DataFrame:
    """(name, parent, child): for every name with a parent, each link on a way that leads down to it.

    Together they are all full paths of the name, whose number may be exponential; names on circles and below them are included.
    """
    links = materialize(links, "links")
    above = closure(links, per_split).where("ancestor <> name").select(F.col("ancestor").alias("child"), "name")
    return links.select(F.col("child").alias("name"), "parent", "child").unionByName(above.join(links, "child").select("name", "parent", "child"))
