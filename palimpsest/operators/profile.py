"""Column profiles: counts, distinct values, lengths and samples.

One pass over a table serves all its columns: columns are unpivoted to (column, value), counted by value,
and summed by column. Spark combines both before their shuffles, so a hot value costs nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 200
DETECTOR_SAMPLE = 40


def as_text(df: DataFrame, column: str) -> Column:
    """A column as text; arrays, maps and structs as JSON."""
    kind = df.schema[column].dataType.typeName()
    c = F.col(f"`{column}`")
    return F.to_json(c) if kind in ("array", "map", "struct") else c.cast("string")


def unpivoted(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``column`` and ``value`` (text) for every cell."""
    columns = df.columns if columns is None else columns
    cells = F.array(*[F.struct(F.lit(c).alias("column"), as_text(df, c).alias("value")) for c in columns])
    return df.select(F.explode(cells).alias("cell")).select("cell.column", "cell.value")


def aggregates(df: DataFrame, columns: list[str] | None = None, exact: bool = True) -> DataFrame:
    """``column``, ``rows``, ``non_null``, ``distinct_values``, ``average_length``, ``null_share``.

    Distinct values are counted at every size; only ``exact=False`` estimates them. An empty table gives a
    row of zeros for each column.
    """
    columns = df.columns if columns is None else columns
    cells = unpivoted(df, columns)
    if exact:
        by_value = cells.groupBy("column", "value").agg(F.count("*").alias("n"))
        known = F.col("value").isNotNull()
        found = by_value.groupBy("column").agg(
            F.sum("n").alias("rows"), F.sum(F.when(known, F.col("n")).otherwise(0)).alias("non_null"), F.count("value").alias("distinct_values"),
            F.sum(F.when(known, F.col("n") * F.length("value")).otherwise(0)).alias("length"),
        )
    else:
        found = cells.groupBy("column").agg(F.count("*").alias("rows"), F.count("value").alias("non_null"), F.approx_count_distinct("value", 0.01).alias("distinct_values"), F.sum(F.length("value")).alias("length"))
    every = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    found = every.join(found, "column", "left").fillna(0, ["rows", "non_null", "distinct_values", "length"])
    return found.select("column", "rows", "non_null", "distinct_values", F.when(F.col("non_null") > 0, F.col("length") / F.col("non_null")).otherwise(0.0).alias("average_length"), null_share(F.col("rows"), F.col("non_null")).alias("null_share"))


def null_share(rows: Column, non_null: Column) -> Column:
    """Share of nulls, 0 for an empty table."""
    return F.when(rows > 0, (rows - non_null) / rows).otherwise(0.0)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """All different texts of a column, as ``value``."""
    return df.select(as_text(df, column).alias("value")).where("value is not null").distinct()


def distinct_sample(df: DataFrame, column: str, size: int = SAMPLE) -> DataFrame:
    """Some different texts of a column, chosen by digest, so that reruns agree."""
    return distinct_values(df, column).orderBy(F.md5("value"), "value").limit(size)


def samples(df: DataFrame, columns: list[str], size: int = SAMPLE) -> dict[str, list[str]]:
    """``distinct_sample`` of several columns at once, on the driver (``size`` values each)."""
    from pyspark.sql import Window

    values = unpivoted(df, columns).where("value is not null").distinct()
    # ranked within parts first, so that no column is sorted in one task
    for part in ([F.pmod(F.xxhash64("value"), F.lit(64))], []):
        w = Window.partitionBy("column", *part).orderBy(F.md5("value"), "value")
        values = values.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= size)
    out: dict[str, list[str]] = {c: [] for c in columns}
    for row in values.orderBy("column", "rank").collect():
        out[row["column"]].append(row["value"])
    return out


def keyed_values(df: DataFrame, key: str, column: str, limit: int | None = None) -> DataFrame:
    """``key`` and ``value`` as text of non-null values, in order of the key's text."""
    out = df.select(as_text(df, key).alias("key"), as_text(df, column).alias("value")).where("value is not null").orderBy("key")
    return out if limit is None else out.limit(limit)


def share(predicate: Column) -> Column:
    """Share of rows that satisfy a predicate (an aggregate; unknown counts as no)."""
    return F.avg(F.coalesce(predicate, F.lit(False)).cast("int"))


def not_blank(c: Column) -> Column:
    """Neither null nor white space only (Unicode)."""
    return c.isNotNull() & c.rlike(r"(?U)\S")
