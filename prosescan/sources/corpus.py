"""Sample files, rule extractions, profiles and runs: scans, validation and sinks."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prosescan.functions.text import trim_all

# Fields and domains of a sample's front matter.
REQUIRED = ["id", "category", "language", "mode", "provenance", "source", "licence", "notes"]
OPTIONAL = ["model", "expected", "user_turn", "advice_permission"]
DOMAINS = {
    "language": ["zh", "en", "unknown"],
    "mode": ["chat", "prose", "formal", "technical", "public", "unknown"],
    "provenance": ["human-written", "model-generated", "model-then-edited"],
    "advice_permission": ["granted", "absent", "unknown"],
    "category": ["chinese-prose", "english-prose", "chinese-chat", "english-chat", "formal-writing", "technical-writing", "translated-chinese", "ai-pretending-casual", "real-human-chat"],
}
ID = r"^[a-z]{2}-[a-z-]+-\d{4}\z"
NOT_SAMPLES = ["README.md", "NOT_POPULATED.md"]
THIN_CATEGORY = 20

EXTRACTION = (
    "schemaVersion string, result struct<upstream:string,sourceCommit:string,sources:array<string>,rules:array<struct<upstreamRuleId:string,upstream:string,category:string,"
    "languages:array<string>,title:string,description:string,detection:string,rewriteGuidance:string,severity:int,signature:string,weakAlone:boolean,locator:string,"
    "watchPhrases:array<struct<text:string,kind:string,match:string,note:string>>>>,warnings:array<string>,disclosures:array<string>>"
)
PROFILE = "schemaVersion string, id string, owner string, kind string, languages array<string>, sources array<string>, directives array<string>, writing struct<burstiness:double,signatureVocabulary:array<string>,avoidVocabulary:array<string>>"


def read_samples(spark: SparkSession, root: str, only: list[str] | None = None) -> DataFrame:
    """(path, directory, text) of the Markdown files below the root's category folders."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    rows = files.select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    rows = rows.select("path", F.element_at(F.split("path", "/"), -2).alias("directory"), F.element_at(F.split("path", "/"), -1).alias("file"), "text")
    rows = rows.where(~F.col("file").isin(*NOT_SAMPLES)).drop("file")
    return rows.where(F.col("directory").isin(*only)) if only else rows


def front_matter(text: Column) -> Column:
    """map of the fields between the first two lines of dashes; folded and literal blocks are joined with spaces and line ends. A key that comes twice keeps its first value; ``violations`` reports it."""
    return F.map_from_entries(first_entries(entries(text)))


def entries(text: Column) -> Column:
    """array<struct<k,v>> of the fields of the front matter, in order; a field may come twice."""
    head = F.regexp_extract(text, r"(?s)\A---\r?\n(.*?)\r?\n---(?:\r?\n|\z)", 1)
    pairs = F.regexp_extract_all(head, F.lit(r"(?m)^([A-Za-z_]+):[ \t]*((?:[|>][-+]?[ \t]*\r?\n(?:[ \t]+.*\r?\n?|[ \t]*\r?\n)*)|.*)$"), F.lit(0))

    def value(pair: Column) -> Column:
        raw = F.regexp_replace(pair, r"\A[A-Za-z_]+:[ \t]*", "")
        block = F.regexp_replace(raw, r"\A[|>][-+]?[ \t]*\r?\n", "")
        literal = F.trim(F.regexp_replace(block, r"(?m)^[ \t]+", ""))
        return F.when(raw.rlike(r"\A\|"), literal).when(raw.rlike(r"\A>"), F.regexp_replace(literal, r"\s*\n\s*", " ")).otherwise(F.regexp_replace(F.trim(raw), r"""\A(["'])(.*)\1\z""", "$2"))

    return F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, r"\A([A-Za-z_]+):", 1).alias("k"), value(p).alias("v")))


def first_entries(keyed: Column) -> Column:
    """The entries without those whose key came before."""
    return F.filter(keyed, lambda x, i: ~F.exists(F.slice(keyed, 1, i), lambda y: y["k"] == x["k"]))


def parsed_samples(files: DataFrame) -> DataFrame:
    """Samples with their fields as columns and the text as ``body``."""
    rows = files.withColumn("entries", entries(F.col("text"))).withColumn("fm", F.map_from_entries(first_entries(F.col("entries"))))
    fields = [F.col("fm")[c].alias(c) for c in REQUIRED + OPTIONAL]
    repeated = F.size("entries") > F.size("fm")
    return rows.select("path", "directory", *fields, repeated.alias("repeated_key"), trim_all(F.regexp_replace("text", r"(?s)\A---\r?\n.*?\r?\n---(?:\r?\n|\z)", "")).alias("body"))


def violations(samples: DataFrame) -> DataFrame:
    """(path, problem): one row for each rule that a sample breaks."""
    col = F.col
    problems = [F.when(F.coalesce(col(c), F.lit("")) == "", F.lit(f"missing {c}")) for c in [*REQUIRED, "body"]]
    problems += [F.when(col(c).isNotNull() & ~col(c).isin(*values), F.lit(f"unknown {c}")) for c, values in DOMAINS.items()]
    problems += [
        F.when(~col("id").rlike(ID), F.lit("bad id")), F.when(col("category") != col("directory"), F.lit("category differs from directory")),
        F.when((col("provenance") != "human-written") & col("model").isNull(), F.lit("model missing")), F.when((col("provenance") == "human-written") & col("model").isNotNull(), F.lit("model given")),
        F.when(col("advice_permission").isNotNull() & col("user_turn").isNull(), F.lit("permission without turn")), F.when(col("repeated_key"), F.lit("repeated key")),
    ]
    each = samples.select("path", F.explode(F.array_compact(F.array(*problems))).alias("problem"))
    twice = samples.groupBy("id").agg(F.count("*").alias("n"), F.min("path").alias("path")).where("n > 1 and id is not null").select("path", F.lit("duplicate id").alias("problem"))
    return each.unionByName(twice)


def corpus_counts(samples: DataFrame) -> DataFrame:
    """(category, n, state): every known category, 'unpopulated', 'thin' or 'populated'."""
    known = samples.sparkSession.createDataFrame([(c,) for c in DOMAINS["category"]], "category string")
    counts = known.join(samples.groupBy("category").agg(F.count("*").alias("n")), "category", "left").fillna(0, ["n"])
    return counts.withColumn("state", F.when(F.col("n") == 0, "unpopulated").when(F.col("n") < THIN_CATEGORY, "thin").otherwise("populated"))


def corpus_hash(samples: DataFrame, row_id: str, fields: list[str]) -> DataFrame:
    """(n, hash): a hash of all samples that doesn't depend on their order and that no task needs the corpus for.

    Each sample's SHA-256 covers its id and fields, parted by unit separators, null as empty. The samples fall into 4,096
    buckets by the first three digits of their digest; a bucket is its number of samples and the sums of the digests' four
    parts of 16 digits; the hash covers the buckets' lines in order.
    """
    one = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in [row_id, *fields]]), 256)
    hashed = samples.select(one.alias("h"))
    parts = [F.sum(F.conv(F.substring("h", 1 + 16 * i, 16), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(4)]
    sums = hashed.groupBy(F.substring("h", 1, 3).alias("bucket")).agg(F.count("*").alias("n"), *parts)
    line = F.concat_ws(":", "bucket", "n", *[F.col(f"s{i}").cast("string") for i in range(4)])
    return sums.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256).alias("hash"))


def read_extractions(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rule candidates of the extraction files that exist; absent files are skipped."""
    jvm = spark._jvm
    there = []
    for p in paths:
        where = jvm.org.apache.hadoop.fs.Path(p)
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            there.append(p)
    rows = spark.read.schema(EXTRACTION).json(there, multiLine=True) if there else spark.createDataFrame([], EXTRACTION)
    return rows.select("schemaVersion", F.col("result.sourceCommit").alias("source_commit"), F.explode("result.rules").alias("r")).select("schemaVersion", "source_commit", "r.*")


def save_profiles(profiles: DataFrame, root: str) -> None:
    """Profiles as JSON lines by owner; a profile's file name is its id with its slashes doubled as underscores."""
    profiles.withColumn("file", F.replace("id", F.lit("/"), F.lit("__"))).write.mode("append").partitionBy("owner").json(root)


def load_profiles(spark: SparkSession, root: str, profile_id: str | None = None) -> DataFrame:
    rows = spark.read.schema(PROFILE).json(root)
    return rows.where(F.col("id") == profile_id) if profile_id else rows


def profile_problems(profiles: DataFrame) -> DataFrame:
    """(id, problem) of profiles that break a constraint."""
    c = F.col
    problems = [
        F.when(c("schemaVersion") != "1.0.0", F.lit("unknown schema")), F.when(~c("id").rlike(r"^[a-z0-9-]+/[a-z0-9-]+\z"), F.lit("bad id")),
        F.when(~F.startswith(c("id"), F.concat(c("owner"), F.lit("/"))), F.lit("id not of owner")), F.when(F.coalesce(F.size("languages"), F.lit(0)) < 1, F.lit("no language")),
        F.when(~c("kind").isin("chat", "writing", "mixed"), F.lit("unknown kind")),
    ]
    return profiles.select("id", F.explode(F.array_compact(F.array(*problems))).alias("problem"))


def save_run(results: DataFrame, root: str, run_id: str, corpus: str) -> None:
    """A run's results; a run without a corpus hash is refused."""
    if not corpus:
        raise ValueError("a run needs its corpus hash")
    results.withColumn("corpus_hash", F.lit(corpus)).withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(root)


def load_run(spark: SparkSession, root: str, run_id: str | None = None) -> DataFrame:
    """The run of that name, else the latest by name."""
    runs = spark.read.parquet(root)
    run_id = run_id or runs.agg(F.max("run_id")).first()[0]
    return runs.where(F.col("run_id") == run_id)


def list_runs(spark: SparkSession, root: str) -> DataFrame:
    """(run_id, corpus_hash, n) of every saved run, by name; runs of another corpus hash can't be compared."""
    return spark.read.parquet(root).groupBy("run_id", "corpus_hash").agg(F.count("*").alias("n")).orderBy("run_id")


def contained(root: str, path: str) -> str:
    """A path below the root; one that leads out of it is refused."""
    whole = posixpath.normpath(posixpath.join(root, path))
    if whole != posixpath.normpath(root) and not whole.startswith(posixpath.normpath(root) + "/"):
        raise ValueError(f"outside of {root}: {path}")
    return whole


def manifest_problems(manifest: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(name, problem): missing fields, bad commits and dates, parents without a row."""
    c = F.col
    problems = [F.when(F.coalesce(F.trim(c(f)), F.lit("")) == "", F.lit(f"missing {f}")) for f in ("name", "repository", "license")]
    problems += [F.when(~c("commit_sha").rlike(r"^[0-9a-f]{40}\z"), F.lit("bad commit")), F.when(F.try_to_date("last_sync", "yyyy-MM-dd").isNull() & c("last_sync").isNotNull(), F.lit("bad date")), F.when(F.coalesce(F.size("roles"), F.lit(0)) < 1, F.lit("no role"))]
    rows = manifest.distinct()
    own = rows.select("name", F.explode(F.array_compact(F.array(*problems))).alias("problem"))
    parents = rows.select("name", F.explode("derived_from").alias("parent")).select("name", F.lower(F.trim("parent")).alias("parent")).distinct()
    there = rows.select(F.lower(F.trim("name")).alias("parent")).distinct()
    lost = parents.join(there, "parent", "left_anti").select("name", F.concat(F.lit("unknown parent "), F.col("parent")).alias("problem"))
    return own.unionByName(lost)
