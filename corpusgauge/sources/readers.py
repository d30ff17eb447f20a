"""File readers: metric CSVs, story folders, nested JSON, JSON-lines logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgauge.operators.tables import keep_first


def read_metrics_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Wide metrics table; NaN and blank cells become NULL."""
    df = spark.read.csv(path, header=True, schema=schema, nanValue="NaN", mode="PERMISSIVE", escape='"')
    doubles = {f.name for f in df.schema if f.dataType.simpleString() == "double"}
    return df.select(*[F.nanvl(F.col(c), F.lit(None)).alias(c) if c in doubles else F.col(c) for c in df.columns])


def checked_metrics_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Wide metrics table with a ``reason`` column: NULL for a whole line, else why the line is set apart.

    ``type: column`` names the first field that is not of its type, ``fields`` stands
    for too few or too many fields; ``line`` is the raw text of such a line, and its
    readable fields keep their values.  Split into good and bad with one filter each.
    """
    bad = "line"
    # Every field is parsed even where a query reads few, so a line is broken or not whatever is asked.
    # The reason looks at the parsed fields: Spark refuses queries of the raw text alone.
    options = {"header": True, "nanValue": "NaN", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad, "escape": '"', "columnPruning": False}
    df = spark.read.options(**options).schema(f"{schema}, {bad} string").csv(path)
    fields = [f for f in df.schema if f.name != bad]
    # Only broken lines are parsed again, as plain strings.
    text = ", ".join(f"`{f.name}` string" for f in fields)
    raw = F.when(F.col(bad).isNotNull(), F.from_csv(F.col(bad), text, {"escape": '"'}))
    reason = F.when(F.col(bad).isNotNull(), F.lit("fields"))
    for f in reversed(fields):
        given = raw[f.name]
        wrong = (F.trim(given) != "") & F.col(f.name).isNull()
        reason = F.when(wrong, f"type: {f.name}").otherwise(reason)
    values = [F.nanvl(F.col(f.name), F.lit(None)).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name) for f in fields]
    return df.select(*values, reason.alias("reason"), bad)


def pick_story_file(files: DataFrame, folder: str, name: str, wanted: Sequence[str]) -> DataFrame:
    """Per folder the first existing of several file names, in order of choice."""
    choice = F.array_position(F.array(*[F.lit(w) for w in wanted]), F.col(name))
    ranked = files.withColumn("choice", choice).where("choice > 0")
    return keep_first(ranked, [folder], ["choice", name])


def read_stories(spark: SparkSession, path: str, wanted: Sequence[str]) -> DataFrame:
    """One row per run folder: folder, file name and whole text."""
    parts = F.split(F.input_file_name(), "/")
    files = (
        spark.read.option("recursiveFileLookup", "true")
        .text(path, wholetext=True)
        .select(
            F.element_at(parts, -2).alias("folder"),
            F.url_decode(F.element_at(parts, -1)).alias("file"),
            F.col("value").alias("text"),
        )
    )
    return pick_story_file(files, "folder", "file", wanted)


def read_nested_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.json(path, schema=schema, multiLine=True)


def report(text: Column) -> Column:
    """JSON text of any shape as a VARIANT; NULL if it does not decode."""
    return F.try_parse_json(text)


def report_field(doc: Column, path: str, kind: str, default: object = None) -> Column:
    """A field of a report; the default if it is missing, null or of another shape."""
    value = F.try_variant_get(doc, path, kind)
    return value if default is None else F.coalesce(value, F.lit(default))


def report_items(df: DataFrame, doc: str, path: str, place: str, item: str) -> DataFrame:
    """One row per item of a report's array (``place`` from 0); a report without that array gives no row."""
    spread = df.withColumn("__in", F.try_variant_get(doc, path, "variant"))
    items = spread.sparkSession.tvf.variant_explode(F.col("__in").outer()).select(F.col("pos").alias(place), F.col("key").alias("__key"), F.col("value").alias(item))
    return spread.lateralJoin(items).where("__key is null").drop("__in", "__key")


def report_entries(df: DataFrame, doc: str, path: str, key: str, item: str) -> DataFrame:
    """One row per entry of a report's map; a report without that map gives no row."""
    spread = df.withColumn("__in", F.try_variant_get(doc, path, "variant"))
    items = spread.sparkSession.tvf.variant_explode(F.col("__in").outer()).select(F.col("key").alias(key), F.col("value").alias(item))
    return spread.lateralJoin(items).where(F.col(key).isNotNull()).drop("__in")


def read_log_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON-lines log; lines that do not decode are dropped."""
    return spark.read.json(path, schema=schema, mode="DROPMALFORMED")


def decoded(lines: Column, schema: str) -> Column:
    """JSON text to a struct; NULL for a line that does not decode."""
    bad = "_bad"
    parsed = F.from_json(lines, f"{schema}, {bad} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad})
    return F.when(parsed[bad].isNull(), parsed)
