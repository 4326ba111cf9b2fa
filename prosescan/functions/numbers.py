"""Scores, distances and map arithmetic as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp_score(x: Column) -> Column:
    """A score between 0 and 1; 0 for a value that isn't finite, null stays null."""
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), 0.0).otherwise(F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))))


def clamp_severity(x: Column) -> Column:
    """A severity between 1 and 5; 3 for null and for what is no number."""
    x = x.cast("double")
    return F.when(x.isNull() | F.isnan(x), 3).otherwise(F.greatest(F.lit(1), F.least(F.lit(5), F.round(x).cast("int"))))


def tolerance_score(distance: Column, tolerance: Column) -> Column:
    """1 within the tolerance, then falling with the distance in units of it; 0 for a distance that isn't finite."""
    beyond = F.greatest(F.lit(0.0), distance - tolerance)
    score = F.when(tolerance <= 0, F.when(distance <= 0, 1.0).otherwise(0.0)).otherwise(1 / (1 + beyond / tolerance))
    return F.when(F.isnan(distance) | (F.abs(distance) == F.lit(float("inf"))), 0.0).otherwise(score)


def total(rates: Column) -> Column:
    """Sum of a map's values."""
    return F.aggregate(F.map_values(rates), F.lit(0.0), lambda a, x: a + x)


def rate_distance(a: Column, b: Column) -> Column:
    """Sum of differences of two rate maps over the sum of their rates; 0 if both are empty."""
    parts = F.map_zip_with(a, b, lambda _, x, y: F.abs(F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0))))
    return F.coalesce(F.try_divide(total(parts), total(a) + total(b)), F.lit(0.0))


def blend_rates(a: Column, b: Column, weight: Column) -> Column:
    """Weighted mixture of two rate maps; a key that one lacks counts as 0 there."""
    return F.map_zip_with(a, b, lambda _, x, y: F.round(F.coalesce(x, F.lit(0.0)) * weight + F.coalesce(y, F.lit(0.0)) * (1 - weight), 4))


def blend_distributions(a: Column, b: Column, weight: Column) -> Column:
    """Mixture of two distribution structs by the law of total variance; an empty one gives way to the other."""
    w = F.greatest(F.lit(0.0), F.least(F.lit(1.0), weight))
    m = a["mean"] * w + b["mean"] * (1 - w)
    v = w * (F.pow(a["std_dev"], 2) + F.pow(a["mean"] - m, 2)) + (1 - w) * (F.pow(b["std_dev"], 2) + F.pow(b["mean"] - m, 2))
    mixed = F.struct(F.round(m, 4).alias("mean"), F.round(a["median"] * w + b["median"] * (1 - w), 4).alias("median"), F.round(F.sqrt(v), 4).alias("std_dev"), F.least(a["min"], b["min"]).alias("min"), F.greatest(a["max"], b["max"]).alias("max"), (a["sample_count"] + b["sample_count"]).alias("sample_count"))
    return F.when(a["sample_count"] == 0, b).when(b["sample_count"] == 0, a).otherwise(mixed)


def punctuation_score(measured: Column, profile: Column) -> Column:
    """How alike two punctuation rate maps are, by their mix and by their density; 1 if nothing is measured."""
    used = F.map_filter(measured, lambda _, x: x > 0)
    here = total(used)
    there = F.aggregate(F.map_keys(used), F.lit(0.0), lambda a, k: a + F.coalesce(F.try_element_at(profile, k), F.lit(0.0)))
    apart = F.aggregate(F.map_entries(used), F.lit(0.0), lambda a, e: a + F.abs(e["value"] / here - F.coalesce(F.try_element_at(profile, e["key"]), F.lit(0.0)) / there))
    mix = F.when(there == 0, 0.5).otherwise(apart / 2)
    density = F.coalesce(F.try_divide(total(measured), total(profile)), F.lit(1.0))
    near = tolerance_score(F.abs(F.log(F.greatest(density, F.lit(1e-6)))), F.lit(0.6931471805599453))
    score = clamp_score(0.75 * clamp_score(1 - mix * 2) + 0.25 * near)
    return F.when(F.size(used) == 0, 1.0).otherwise(score)
