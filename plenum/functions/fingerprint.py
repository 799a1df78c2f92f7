"""Content hashes of rows and tables that do not depend on row order."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.functions.text import hex_number


def row_hash(columns: list[str]) -> Column:
    """sha-256 of the row as JSON with sorted keys, NULL fields kept."""
    fields = F.struct(*sorted(columns))
    return F.sha2(F.to_json(fields, {"ignoreNullFields": "false"}), 256)


def table_fingerprint(
    df: DataFrame, columns: list[str] | None = None, groups: list[str] | None = None
) -> DataFrame:
    """Rows and the sum of row hash prefixes, as text; partial sums combine."""
    columns = columns or [c for c in df.columns if c not in (groups or [])]
    part = hex_number(row_hash(columns), 15)
    return df.groupBy(*(groups or [])).agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(part), F.lit(0).cast("decimal(30,0)")).cast("string").alias("content_hash"),
    )


def settings_fingerprint(**settings) -> Column:
    """Hash of a job's settings (a small dict known on the driver)."""
    return F.sha2(F.lit(json.dumps(settings, sort_keys=True, default=str)), 256)
