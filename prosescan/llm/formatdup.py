"""Records that differ only by formatting, collapsed and counted.

The distinct values of all fields form one dictionary, in which each is canonicalised once and
gets the integer identifier of its canonical form. Records become tuples of these integers in
field order, and equal tuples are copies. Values and tuples that hold a large share of the rows
are joined by broadcast (there can be only a few thousand), so no key makes a task long.

Defined results: an absent, null or empty value, and one without any letter or digit, are the
same; accents count in composed and in combining form alike; a null payload and one that is no
JSON object is no record and has no row; extra JSON fields are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosescan.functions.scratch import join_by_frequency, materialize

NOISE = regex.compile(r"[^\p{L}\p{Nd}]+")


def canonical(value: str) -> str:
    """Letters and digits alone, caseless; a letter and its combining accent count as the accented letter."""
    folded = unicodedata.normalize("NFC", unicodedata.normalize("NFC", value).casefold())
    return NOISE.sub("", folded)


def _canonical_column(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in values:
        yield batch.map(canonical)


def json_fields(payload: Column, fields: Sequence[str]) -> Column:
    """Struct of the named fields of a JSON object as strings, absent and null ones empty; null if it is no object."""
    parsed = F.from_json(payload, ", ".join(f"`{f}` string" for f in fields), {"mode": "PERMISSIVE"})
    is_object = F.get_json_object(payload, "$").startswith("{")
    return F.when(is_object & parsed.isNotNull(), F.struct(*[F.coalesce(parsed[f], F.lit("")).alias(f) for f in fields]))


def encoded(records: DataFrame, row_id: str, fields: Sequence[str]) -> DataFrame:
    """(row_id, codes): each record as its tuple of value identifiers, in field order.

    ``fields`` are string columns; identifiers are equal exactly where canonical values are.
    """
    pieces = records.select(F.col(row_id).alias("row_id"), F.posexplode(F.array(*[F.coalesce(F.col(f), F.lit("")) for f in fields])).alias("field", "value"))
    pieces = materialize(pieces, "pieces")
    canon = F.pandas_udf(_canonical_column, "string")
    values = pieces.groupBy("value").agg(F.count("*").alias("n")).withColumn("canon", canon("value"))
    values = materialize(values, "values")
    forms = values.groupBy("canon").agg(F.sum("n").alias("forms_n"))
    forms = materialize(forms.withColumn("code", F.monotonically_increasing_id()), "forms")
    dictionary = materialize(join_by_frequency(values, forms, ["canon"], "forms_n").select("value", "n", "code"), "dictionary")
    coded = join_by_frequency(pieces, dictionary, ["value"], "n").select("row_id", "field", "code")
    tuples = coded.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("field", "code"))).alias("codes"))
    return tuples.select("row_id", F.col("codes.code").alias("codes"))


def format_groups(records: DataFrame, row_id: str, fields: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Groups (keep_id, codes, n_copies) with the smallest row id as keep_id, and rows (row_id, codes)."""
    tuples = materialize(encoded(records, row_id, fields), "tuples")
    groups = tuples.groupBy("codes").agg(F.min("row_id").alias("keep_id"), F.count("*").alias("n_copies"))
    return materialize(groups, "groups"), tuples


def format_duplicates(records: DataFrame, row_id: str, fields: Sequence[str]) -> DataFrame:
    """(keep_id, copy_id) of every record that repeats one with a smaller row id."""
    groups, tuples = format_groups(records, row_id, fields)
    members = join_by_frequency(tuples, groups.where("n_copies > 1"), ["codes"], "n_copies")
    return members.where("row_id <> keep_id").select("keep_id", F.col("row_id").alias("copy_id"))


def collapsed(records: DataFrame, row_id: str, fields: Sequence[str]) -> DataFrame:
    """One record per group, as written in its row with the smallest id, with the number of its copies."""
    groups, _ = format_groups(records, row_id, fields)
    kept = records.select(F.col(row_id).alias("keep_id"), *[F.col(f).alias(f) for f in fields])
    return kept.join(groups.select("keep_id", "n_copies"), "keep_id")
