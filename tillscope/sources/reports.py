"""CSV output of report frames."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_report(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write a report as CSV with a header and doubled quotes.

    Executors write their own parts, in order; a top-k report has one part, a long listing several.
    """
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)
