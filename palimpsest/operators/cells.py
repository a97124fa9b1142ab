"""Rewriting all columns of a large table in one go, with a dictionary that is never shuffled.

Cells of all planned columns are unpivoted to (row, column, key). Their different keys, combined before the
shuffle, are resolved once, and the outcome lies bucketed by key like the dictionary itself, so both are
joined where they lie. Cells meet it in one shuffle of cells, are put back together by row in another, and
the table itself is shuffled once, whatever the number of columns. A key of more than ``1 / HOT`` of all
cells (there can be fewer than ``HOT`` of them) goes to every executor instead of to one; its cells travel with
the number of their word.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.canonical import canonical
from palimpsest.functions.prf import Secret, fingerprint, index_hex
from palimpsest.plans.model import FREE_TEXT, PolicyColumn
from palimpsest.plans.rulepack import RulePack
from palimpsest.plans.storage import stage_table, work_dir

from .dictionary import function_replacement
from .generators import Renderers

#: A key is hot from this part of all cells on; its cells are spread over so many keys.
HOT, SPREAD = 500, 4096


def _count(spark: SparkSession, buckets: int | None) -> int:
    return buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucketed(df: DataFrame, by: list[str], buckets: int | None = None, path: str | None = None) -> DataFrame:
    """``df`` written in ``buckets`` (default: the session's shuffle partitions) by the columns ``by``, sorted in each.

    ``path`` keeps it for later sessions, which read it by ``open_bucketed``; without one it lies in the
    shared folder.
    """
    spark = df.sparkSession
    path, n = path or f"{work_dir(spark)}/bucketed-{uuid.uuid4().hex}", _count(spark, buckets)
    name = f"palimpsest_{uuid.uuid4().hex}"
    df.repartition(n, *by).write.bucketBy(n, *by).sortBy(*by).option("path", f"{path}/data").saveAsTable(name)
    spark.createDataFrame([(json.dumps({"by": by, "buckets": n, "schema": df.schema.jsonValue()}),)], "value string").coalesce(1).write.text(f"{path}/layout")
    return spark.table(name)


def open_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """A table that ``bucketed`` has written, with its layout."""
    layout = json.loads(spark.read.text(f"{path}/layout").first()["value"])
    columns = ", ".join(f"`{f['name']}` {f['type']}" for f in layout["schema"]["fields"])
    by, name = ", ".join(f"`{c}`" for c in layout["by"]), f"palimpsest_{uuid.uuid4().hex}"
    where = f"{path}/data".replace("'", r"\'")
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {layout['buckets']} BUCKETS LOCATION '{where}'")
    return spark.table(name)


def resolve_all(keys: DataFrame, dictionary: DataFrame, pack: RulePack, secret: Secret, exceptions: list[str] | None = None, types: list[str] | None = None) -> DataFrame:
    """``keys`` (``type``, ``key``, and whatever else) with ``replacement``: as ``rewrite.resolve`` does for one type.

    ``types``: those that stand in ``type``.
    """
    at = secret.keyed(keys).withColumn("label", F.lit(""))
    if exceptions:
        listed = keys.sparkSession.createDataFrame([(e,) for e in sorted(set(exceptions))], "mark string").withColumn("excepted", F.lit(True))
        at = at.withColumn("mark", fingerprint(F.col("key"))).join(F.broadcast(listed), "mark", "left")
        at = at.withColumn("label", F.when(F.col("excepted"), F.col("type")).otherwise(""))
    at = at.select(*keys.columns, "label", index_hex(F.col("key"), F.col("label")).alias("index"))
    at = at.join(dictionary.select(F.col("key"), F.col("replacement").alias("listed")), "key", "left")
    at = at.withColumn("listed", F.when(F.col("label") == "", F.col("listed")))
    made: Column = F.raise_error(F.concat(F.lit("no generator for type "), F.col("type"))).cast("string")
    renderers = Renderers(pack)
    for t in sorted(types or [r["type"] for r in keys.select("type").distinct().collect()]):
        if renderers.supports(t):
            index = F.when(F.col("listed").isNull() & (F.col("type") == t), F.col("index"))
            made = F.when(F.col("type") == t, function_replacement(F.col("key"), index, t, pack)).otherwise(made)
    return at.select(*keys.columns, F.coalesce("listed", made).alias("replacement"))


def _type(c: PolicyColumn) -> str:
    return FREE_TEXT if c.mode == "TextWipe" else c.semantic_type


def _key(c: PolicyColumn) -> Column:
    return canonical(F.col(f"`{c.address.column}`"), "Text" if c.mode == "TextWipe" else c.canonical_kind)


def rewrite_cells(df: DataFrame, columns: list[PolicyColumn], dictionary: DataFrame, pack: RulePack, secret: Secret, row_key: list[str] | None = None, exceptions: list[str] | None = None, buckets: int | None = None) -> DataFrame:
    """``df`` with all ``columns`` (of mode Typed or TextWipe) rewritten; names, order and types stay.

    ``dictionary`` (``key``, ``replacement``) should be ``bucketed`` by ``key`` in as many ``buckets``.
    ``row_key`` names columns, none of them rewritten, that tell the rows apart (a repeated key, or one with
    a null, fails where a value is to be replaced); without them the table is written once with an id. Nulls and blanks stay, any other value is replaced
    or fails. The order of rows is not kept.
    """
    if any(c.mode in ("Document", "TextSpot") for c in columns):
        raise ValueError("cells are whole values: documents and spots within texts are not")
    if row_key and {c.address.column for c in columns} & set(row_key):
        raise ValueError("a rewritten column cannot tell rows apart")
    if not columns:
        return df
    own_id, shown = not row_key, df.columns
    if own_id:
        row_key = ["__row_id"]
        df = stage_table(df.withColumn("__row_id", F.monotonically_increasing_id()), "rows")
    n = _count(df.sparkSession, buckets)
    rows = [F.col(f"`{c}`").alias(f"row{k}") for k, c in enumerate(row_key)]
    row = [f"row{k}" for k in range(len(row_key))]
    each = F.array(*[F.struct(F.lit(k).alias("column"), F.lit(_type(c)).alias("type"), _key(c).alias("key")) for k, c in enumerate(columns)])
    cells = df.select(*rows, F.explode(each).alias("cell")).select(*row, "cell.*").where("key is not null")

    keys = cells.groupBy("type", "key").agg(F.count("*").alias("n"))
    found = bucketed(resolve_all(keys, dictionary, pack, secret, exceptions, sorted({_type(c) for c in columns})), ["type", "key"], n)
    total = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = found.where(F.col("n") * HOT > total)
    words = F.array(*[F.lit(r[0]) for r in hot.select("replacement").where("replacement is not null").distinct().collect()]).cast("array<string>")
    met = cells.join(F.broadcast(hot.select("type", "key", F.array_position(words, F.col("replacement")).alias("hot"))), ["type", "key"], "left")
    # a hot cell meets nothing in the second join; a hash of its row spreads it there
    spread = F.when(F.col("hot").isNull(), F.col("key")).otherwise(F.concat(F.lit("\0"), F.pmod(F.xxhash64(*row), F.lit(SPREAD)).cast("string")))
    met = met.select(*row, "column", "type", spread.alias("key"), F.col("hot").cast("int").alias("hot")).join(found.select("type", "key", "replacement"), ["type", "key"], "left")
    # cells are dealt by row as they are: partial sums of a row would be wider than its cells
    met = met.select(*row, "column", F.coalesce(F.concat(F.lit("#"), "hot"), F.concat(F.lit("="), "replacement")).alias("word")).repartition(*row)
    put = met.groupBy(*row).agg(*[F.max(F.when(F.col("column") == k, F.col("word"))).alias(f"new{k}") for k in range(len(columns))], *[F.count_if(F.col("column") == k).alias(f"times{k}") for k in range(len(columns))])
    same = [F.col(f"`{c}`") == F.col(r) for c, r in zip(row_key, row, strict=True)]
    out = df.join(put, same, "left")
    news = {}
    for k, c in enumerate(columns):
        name = c.address.column
        lost = F.raise_error(F.lit(f"{c.address.qualified}: a value without replacement")).cast("string")
        twice = F.raise_error(F.lit(f"{c.address.qualified}: several rows have one row key")).cast("string")
        new = F.col(f"new{k}")
        word = F.when(new.startswith("#"), F.element_at(words, F.substring(new, 2, 9).cast("int"))).otherwise(F.expr(f"substring(new{k}, 2)"))
        value = F.when(F.col(f"times{k}") > 1, twice).otherwise(F.coalesce(word, lost))
        news[name] = F.when(_key(c).isNull(), F.col(f"`{name}`")).otherwise(value.cast(df.schema[name].dataType)).alias(name)
    return out.select(*[news.get(c, F.col(f"`{c}`")) for c in shown])
