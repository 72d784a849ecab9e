"""Sinks for results."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_json_lines(df: DataFrame, path: str) -> None:
    """Newline-delimited JSON, one file for each partition."""
    df.write.mode("errorifexists").json(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").parquet(path)
