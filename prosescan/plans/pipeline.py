"""Queries over hierarchies and snapshots, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prosescan.operators import hierarchy, snapshots
from prosescan.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, links = hierarchy.names_and_links(table(spark, sf_dir, "manifest"))
    return hierarchy.closure(links)


def p1_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    nodes = hierarchy.resolve(*hierarchy.names_and_links(table(spark, sf_dir, "manifest")))
    return nodes.select("name", "root", F.col("depth").cast("bigint").alias("depth"), F.array_join("path", " > ").alias("path"), "n_ancestors", "n_descendants", "n_roots", "on_circle")


def p1_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every root of every name."""
    return hierarchy.all_roots(*hierarchy.names_and_links(table(spark, sf_dir, "manifest")))


def p1_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All full paths of every name, as the links they consist of."""
    _, links = hierarchy.names_and_links(table(spark, sf_dir, "manifest"))
    return hierarchy.path_links(links)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.snapshot_changes(table(spark, sf_dir, "rule_snapshots"), "upstream", "source_commit", "extracted_at", "upstream_rule_id", ["title"], "loaded_at")


QUERIES = {"p1_found": p1_found, "p1_nodes": p1_nodes, "p1_roots": p1_roots, "p1_paths": p1_paths, "p5_found": p5_found}

LINKS = r"""
entries AS (
  SELECT lower(trim(name)) AS child, lower(trim(x)) AS parent FROM (SELECT name, unnest(derived_from) AS x FROM manifest)
  UNION
  SELECT lower(trim(name)), lower(trim(regexp_replace(trim(x), '\s*\([^()]*\)$', ''))) FROM (SELECT name, unnest(external_ancestors) AS x FROM manifest)
),
links AS (SELECT DISTINCT child, parent FROM entries WHERE parent <> '' AND child <> ''),
most AS (SELECT count(*) AS n FROM (SELECT DISTINCT child FROM links)),
walks AS (
  SELECT parent AS ancestor, child AS name, 1 AS distance FROM links
  UNION
  SELECT w.ancestor, l.child, w.distance + 1 FROM walks w JOIN links l ON l.parent = w.name, most WHERE w.distance < most.n AND w.ancestor <> w.name
),
pairs AS (SELECT ancestor, name, min(distance) AS distance FROM walks GROUP BY ALL)
"""

SQL = {
    "p1_found": f"WITH RECURSIVE {LINKS} SELECT ancestor, name, distance FROM pairs",
    "p1_nodes": f"""
WITH RECURSIVE {LINKS},
names AS (SELECT lower(trim(name)) AS name FROM manifest UNION SELECT parent FROM links UNION SELECT child FROM links),
roots AS (SELECT name FROM names WHERE name NOT IN (SELECT child FROM links)),
depths AS (SELECT name, min(distance) AS depth FROM pairs WHERE ancestor IN (SELECT name FROM roots) GROUP BY name UNION ALL SELECT name, 0 FROM roots),
ways AS (
  SELECT name, [name] AS path, 0 AS depth FROM roots
  UNION
  SELECT l.child, list_append(w.path, l.child), w.depth + 1 FROM ways w JOIN links l ON l.parent = w.name JOIN depths d ON d.name = l.child AND d.depth = w.depth + 1
),
best AS (SELECT name, min(path) AS path FROM ways GROUP BY name)
SELECT n.name, b.path[1] AS root, len(b.path) - 1 AS depth, array_to_string(b.path, ' > ') AS path,
  (SELECT count(*) FROM pairs p WHERE p.name = n.name AND p.ancestor <> n.name) AS n_ancestors,
  (SELECT count(*) FROM pairs p WHERE p.ancestor = n.name AND p.name <> n.name) AS n_descendants,
  (SELECT count(*) FROM pairs p WHERE p.name = n.name AND p.ancestor IN (SELECT name FROM roots)) AS n_roots,
  EXISTS (SELECT 1 FROM pairs p WHERE p.ancestor = n.name AND p.name = n.name) AS on_circle
FROM names n LEFT JOIN best b ON b.name = n.name
""",
    "p1_roots": f"""
WITH RECURSIVE {LINKS},
names AS (SELECT lower(trim(name)) AS name FROM manifest UNION SELECT parent FROM links UNION SELECT child FROM links),
roots AS (SELECT name FROM names WHERE name NOT IN (SELECT child FROM links))
SELECT name, ancestor AS root, distance FROM pairs WHERE ancestor IN (SELECT name FROM roots) UNION ALL SELECT name, name, 0 FROM roots
""",
    "p5_found": """
WITH snaps AS (
  SELECT upstream, source_commit, row_number() OVER (PARTITION BY upstream ORDER BY min(extracted_at), source_commit) AS pos
  FROM rule_snapshots GROUP BY upstream, source_commit
),
held AS (
  SELECT upstream, source_commit, upstream_rule_id, trim(title, ' ') AS title FROM rule_snapshots
  QUALIFY row_number() OVER (PARTITION BY upstream, source_commit, upstream_rule_id ORDER BY loaded_at DESC NULLS LAST, title DESC NULLS LAST) = 1
),
placed AS (SELECT h.*, s.pos FROM held h JOIN snaps s USING (upstream, source_commit)),
met AS (
  SELECT coalesce(n.upstream, o.upstream) AS upstream, coalesce(n.pos, o.pos + 1) AS pos, coalesce(n.upstream_rule_id, o.upstream_rule_id) AS upstream_rule_id,
    CASE WHEN o.pos IS NULL THEN 'added' WHEN n.pos IS NULL THEN 'removed' WHEN n.title IS DISTINCT FROM o.title THEN 'changed' END AS change_kind
  FROM placed n FULL JOIN placed o ON o.upstream = n.upstream AND o.upstream_rule_id = n.upstream_rule_id AND o.pos + 1 = n.pos
)
SELECT m.upstream, s.source_commit, m.upstream_rule_id, m.change_kind
FROM met m JOIN snaps s ON s.upstream = m.upstream AND s.pos = m.pos
WHERE m.pos > 1 AND m.change_kind IS NOT NULL
""",
}
