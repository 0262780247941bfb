"""CSV ingest: headers to snake case, dirty values to types, in one pass of column expressions."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of the property-sales table and their types.
PROPERTY_SALES: Mapping[str, str] = {
    "unique_id": "integer", "parcel_id": "string", "land_use": "string", "property_address": "string", "sale_date": "date",
    "sale_price": "integer", "legal_reference": "string", "sold_as_vacant": "string", "owner_name": "string",
    "owner_address": "string", "acreage": "decimal", "tax_district": "string", "land_value": "integer",
    "building_value": "integer", "total_value": "integer", "year_built": "integer", "bedrooms": "integer",
    "full_bath": "integer", "half_bath": "integer",
}


def snake_case(header: str) -> str:
    """``UniqueID`` to ``unique_id``, `` Sale Price `` to ``sale_price``."""
    text = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", header.strip().lstrip("﻿"))
    return re.sub(r"[^A-Za-z0-9]+", "_", text).strip("_").lower()


def full(text: Column) -> Column:
    """Trimmed text, null if nothing is left."""
    return F.nullif(F.trim(text), F.lit(""))


def number(text: Column) -> Column:
    """A double from text with currency signs and thousands separators; null if it is none."""
    return full(F.translate(text, "$,", "")).try_cast("double")


def whole(text: Column) -> Column:
    """A whole number, fractions cut off."""
    return number(text).try_cast("bigint")


def long_date(text: Column) -> Column:
    """``April 9, 2013`` or an ISO date; null if it is neither."""
    return F.coalesce(F.try_to_date(full(text), "MMMM d, yyyy"), F.try_to_date(full(text), "yyyy-MM-dd"))


_CLEANERS = {"integer": whole, "decimal": number, "date": long_date, "string": full}


def clean(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Typed columns from text ones, by their snake-case names; columns without a type are trimmed text."""
    return df.select(*[_CLEANERS[types.get(snake_case(c), "string")](F.col(f"`{c}`")).alias(snake_case(c)) for c in df.columns])


def read_csv(spark: SparkSession, path: str, types: Mapping[str, str] = PROPERTY_SALES) -> DataFrame:
    """A CSV file with a header, all text at first (no pass to infer types), then cleaned."""
    raw = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"', encoding="UTF-8")
    return clean(raw, types)


def write_table(df: DataFrame, path: str) -> str:
    """Replace a Parquet table."""
    df.write.mode("overwrite").parquet(path)
    return path
