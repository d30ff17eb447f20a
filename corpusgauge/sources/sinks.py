"""Writers: CSV, JSON lines, Parquet by configuration, Markdown tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"')


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_parquet(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def csv_line(columns: Sequence[str]) -> Column:
    """Quoted CSV fields; quotes inside are doubled, NULL is an empty field."""
    fields = F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])
    keep = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    return F.to_csv(fields, {"quoteAll": "true", "escape": '"', **keep})


def markdown_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every row as a Markdown table line (header and rule line have part 0 and 1)."""
    cell = [F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in columns]
    body = df.select(F.lit(2).alias("part"), F.concat(F.lit("| "), F.concat_ws(" | ", *cell), F.lit(" |")).alias("line"))
    head = [
        (0, "| " + " | ".join(columns) + " |"),
        (1, "|" + "|".join("---" for _ in columns) + "|"),
    ]
    return df.sparkSession.createDataFrame(head, "part int, line string").unionByName(body)


def write_markdown(df: DataFrame, path: str, columns: Sequence[str], order: Sequence[str]) -> None:
    """Report tables are already aggregated, so one output file is enough."""
    markdown_rows(df.orderBy(*order), columns).select("line").coalesce(1).write.mode("overwrite").text(path)
