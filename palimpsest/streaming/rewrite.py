"""The batch rewrite on streams: stateless, row by row, against a static dictionary; or batch by batch, for documents
and exceptions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from palimpsest.functions.canonical import canonical
from palimpsest.functions.prf import Secret, index_hex
from palimpsest.operators.dictionary import function_replacement
from palimpsest.operators.generators import Renderers
from palimpsest.plans.model import FREE_TEXT, PolicyColumn
from palimpsest.plans.rulepack import RulePack


def rewrite_stream(stream: DataFrame, columns: list[PolicyColumn], dictionary: DataFrame, pack: RulePack, secret: Secret) -> DataFrame:
    """A stream's rows with planned columns replaced; works on batches, too, and keeps no state.

    Each value takes the dictionary's word or else the function's: the same values as the batch rewrite.
    """
    names = stream.columns
    out = secret.keyed(stream)
    for n, c in enumerate(columns):
        if c.mode not in ("Typed", "TextWipe"):
            raise ValueError(f"{c.address.qualified}: mode {c.mode} is for batches only")
        name, wiped = c.address.column, c.mode == "TextWipe"
        semantic_type = FREE_TEXT if wiped else c.semantic_type
        key = canonical(F.col(f"`{name}`"), "Text" if wiped else c.canonical_kind)
        words = dictionary.select(F.col("key").alias(f"__key{n}"), F.col("replacement").alias(f"__word{n}"))
        out = out.withColumn("__own", key).join(words, F.col("__own") == F.col(f"__key{n}"), "left")
        word = F.col(f"__word{n}")
        if Renderers(pack).supports(semantic_type):
            index = F.when(word.isNull(), index_hex(F.col("__own")))
            word = F.coalesce(word, function_replacement(F.col("__own"), index, semantic_type, pack))
        word = F.coalesce(word, F.raise_error(F.lit(f"{c.address.qualified}: a value without replacement")).cast("string"))
        new = F.when(F.col("__own").isNull(), F.col(f"`{name}`")).otherwise(word.cast(stream.schema[name].dataType))
        out = out.withColumn(name, new).drop("__own", f"__key{n}", f"__word{n}")
    return out.select(*[f"`{c}`" for c in names])


def start(stream: DataFrame, path: str, checkpoint: str, file_format: str = "parquet", **trigger) -> StreamingQuery:
    """Writes a stream's rows as files; a restart goes on where it stopped. Stop it with ``query.stop()``."""
    writer = stream.writeStream.format(file_format).option("path", path).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def start_batches(stream: DataFrame, rewrite: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Rewrites a stream batch by batch, with all that the batch rewrite can do, into ``path``.

    Each batch has a folder of its own that it replaces: one that was stopped or failed on the way, or whose
    end was not noted, is written anew under its number after a restart, and no row is there twice.
    """

    def put(batch: DataFrame, number: int) -> None:
        rewrite(batch).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def written_batches(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of all batches that ``start_batches`` has written."""
    return spark.read.schema(StructType(list(schema.fields)).add("batch", "long")).option("basePath", path).parquet(f"{path.rstrip('/')}/batch=*").select(*[f"`{f.name}`" for f in schema.fields])
