"""From the columns a table happens to have to the five fixed roles."""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import COLUMN_ALIASES
from ..errors import InputError
from ..functions.text import is_junk, json_safe, normalize_text, strip_text

Mapping_ = Mapping[str, "str | None"]


def clean_header(name: str) -> str:
    """Header without byte order marks and surrounding space."""
    return str(name).replace("﻿", "").strip()


def header_key(name: str) -> str:
    """Form in which headers are compared."""
    return re.sub(r"\s+", " ", clean_header(name)).lower()


def clean_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*(clean_header(c) for c in df.columns))


def resolve_columns(df: DataFrame, requested: Mapping_ | None = None) -> dict[str, str | None]:
    """Column per role: the requested one if present, else the first alias found.

    Looks at the schema only. Of headers that compare equal the last one counts.
    """
    requested = requested or {}
    by_key = {header_key(c): c for c in df.columns}
    mapping = {}
    for role, aliases in COLUMN_ALIASES.items():
        wanted = [header_key(requested[role])] if requested.get(role) else []
        mapping[role] = next((by_key[k] for k in wanted + aliases if k in by_key), None)
    if mapping["keyword"] is None:
        raise InputError(
            "KEYWORD_COLUMN_NOT_FOUND",
            "No keyword column found; map one of the detected columns explicitly.",
            columns_detected=list(df.columns),
        )
    return mapping


def preview(df: DataFrame, requested: Mapping_ | None = None, rows: int = 20) -> dict:
    """Detected columns, proposed mapping, row count and the first rows, JSON-safe."""
    df = clean_headers(df)
    return {
        "columns_detected": df.columns,
        "column_mapping": resolve_columns(df, requested),
        "row_count": df.count(),
        "sample_rows": [r.asDict() for r in json_safe(df.limit(rows)).collect()],
    }


def preview_rows(df: DataFrame, order: str, rows: int = 20) -> DataFrame:
    """The first rows in an order, JSON-safe."""
    return json_safe(df.orderBy(order).limit(rows))


def input_checks(
    df: DataFrame, keyword_column: str, profile: DataFrame | None = None
) -> DataFrame:
    """One row per expectation on the input: check, code, failed_rows, passed.

    All counts of rows come from a single pass over the input. With the profile of the files it
    was read from, the files that cannot be read are counted too (``failed_rows`` are files).
    """
    filled = functools.reduce(operator.or_, (F.col(f"`{c}`").isNotNull() for c in df.columns))
    there = keyword_column in df.columns
    keyword = F.col(f"`{keyword_column}`") if there else F.lit(None)
    keyword = strip_text(keyword.cast("string"))
    usable = F.coalesce(~is_junk(F.col("kw")) & (normalize_text(F.col("kw")) != ""), F.lit(False))
    counts = (
        df.select(filled.alias("filled"), keyword.alias("kw"))
        .select("filled", usable.alias("usable"))
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if("filled").alias("filled"),
            F.count_if("usable").alias("usable"),
        )
    )
    checks = F.array(
        F.struct(
            F.lit("has_rows").alias("check"), F.lit("NO_ROWS").alias("code"),
            (F.col("rows") - F.col("filled")).alias("failed_rows"),
            (F.col("filled") > 0).alias("passed"),
        ),
        F.struct(
            F.lit("has_keywords").alias("check"), F.lit("NO_KEYWORDS").alias("code"),
            (F.col("rows") - F.col("usable")).alias("failed_rows"),
            (F.col("usable") > 0).alias("passed"),
        ),
        F.struct(
            F.lit("has_keyword_column").alias("check"),
            F.lit("KEYWORD_COLUMN_NOT_FOUND").alias("code"),
            F.when(F.lit(there), F.lit(0).cast("long")).otherwise(F.col("rows")).alias("failed_rows"),
            F.lit(there).alias("passed"),
        ),
    )
    found = counts.select(F.inline(checks))
    if profile is None:
        return found
    bad = profile.agg(F.count_if(F.col("error_code").isNotNull()).alias("n"))
    return found.unionByName(
        bad.select(
            F.lit("files_parse").alias("check"), F.lit("UNPARSEABLE_FILE").alias("code"),
            F.col("n").alias("failed_rows"), (F.col("n") == 0).alias("passed"),
        )
    )


def require_usable(df: DataFrame, keyword_column: str) -> None:
    """Raise the first failed input check."""
    failed = input_checks(df, keyword_column).where("not passed").limit(1).collect()
    if failed:
        raise InputError(failed[0]["code"], "The input has no usable rows.",
                         keyword_column=keyword_column)
