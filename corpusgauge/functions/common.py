"""Small helpers shared by operators and bindings."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def rnd(column: Column | str, places: int = 6) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, places)


def ratio(top: Column, bottom: Column) -> Column:
    """NULL instead of an error when the divisor is 0."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def corr(a: str, b: str) -> Column:
    """Pearson r as an aggregate; NULL where a side does not vary.

    Spark's own ``corr`` fails on a constant column in ANSI mode.
    """
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    spread = F.stddev_pop(F.when(both, F.col(a))) * F.stddev_pop(F.when(both, F.col(b)))
    return F.try_divide(F.covar_pop(a, b), spread)


def scalar(df: DataFrame) -> Column:
    """A one-row frame as a struct-valued scalar subquery (no join in the plan)."""
    return df.select(F.struct(*df.columns)).scalar()


def attach(df: DataFrame, one_row: DataFrame, name: str) -> DataFrame:
    """Put a one-row frame on every row as struct column ``name``.

    Read its fields from this column: every use of a subquery expression would
    otherwise repeat the subquery's plan.
    """
    return df.withColumn(name, scalar(one_row))


def inline(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Fixed rule table as a local relation; its size is known when written."""
    return F.broadcast(spark.createDataFrame(list(rows), schema))


def sql_values(rows: Iterable[tuple], columns: str) -> str:
    """The same rule table as a VALUES clause."""

    def text(value: object) -> str:
        if value is None:
            return "NULL"
        if isinstance(value, bool):
            return "true" if value else "false"
        if isinstance(value, str):
            return "'" + value.replace("'", "''") + "'"
        if isinstance(value, float):
            return f"{value!r}::DOUBLE"
        return str(value)

    body = ", ".join("(" + ", ".join(text(v) for v in row) + ")" for row in rows)
    return f"(VALUES {body}) AS t({columns})"


def flat(df: DataFrame, keep: Sequence[str | Column], items: Column, name: str, place: str | None = None) -> DataFrame:
    """One row per array item (with its place from 0 when named); empty arrays give none.

    A plain explode makes the optimizer test the array for emptiness in a filter
    near the scan, which works a costly array out twice and before any spread of
    the rows.  The outer form and a test of the item itself avoid that.
    """
    if place:
        rows = df.select(*keep, F.posexplode_outer(items).alias(place, name))
    else:
        rows = df.select(*keep, F.explode_outer(items).alias(name))
    return rows.where(F.col(name).isNotNull())


def flat_structs(df: DataFrame, keep: Sequence[str | Column], items: Column, test: str) -> DataFrame:
    """The same for arrays of structs; ``test`` is a field that is never NULL."""
    return df.select(*keep, F.inline_outer(items)).where(F.col(test).isNotNull())
