"""JSON documents: paths of their texts, and rewriting of texts by path.

A path is the dotted names of objects on the way; array indexes are no part of it. Numbers, booleans and
nulls stay as they are written, blank texts too.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.canonical import canonical
from palimpsest.plans.model import FREE_TEXT

from .profile import not_blank

#: Bytes and levels of documents that the JVM takes apart: each level repeats what lies around a part.
WIDE, DEEP = 1 << 16, 16


class _Number:
    """A number with its own spelling."""

    def __init__(self, text: str):
        self.text = text


_READER = json.JSONDecoder(parse_float=_Number, parse_int=_Number, parse_constant=_Number)
_WRITER = json.JSONEncoder(ensure_ascii=False)


def load(text: str):
    """A document; numbers keep their spelling, objects the order and repetition of names are not kept."""
    return _READER.decode(text)


def dump(value) -> str:
    """JSON without spaces and escapes of letters."""
    if isinstance(value, _Number):
        return value.text
    if isinstance(value, dict):
        return "{" + ",".join(f"{_WRITER.encode(k)}:{dump(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(dump, value)) + "]"
    return _WRITER.encode(value)


def leaves(value, path: str = "") -> Iterator[tuple[str, str]]:
    """(path, text) of all texts that are not blank; a text at the root has the path ``""``."""
    if isinstance(value, dict):
        for name, inner in value.items():
            yield from leaves(inner, f"{path}.{name}" if path else name)
    elif isinstance(value, list):
        for inner in value:
            yield from leaves(inner, path)
    elif isinstance(value, str) and value.strip():
        yield path, value


def replaced(value, change: Callable[[str, str], str], path: str = ""):
    """The document with every such text changed."""
    if isinstance(value, dict):
        return {name: replaced(inner, change, f"{path}.{name}" if path else name) for name, inner in value.items()}
    if isinstance(value, list):
        return [replaced(inner, change, path) for inner in value]
    return change(path, value) if isinstance(value, str) and value.strip() else value


def _brackets(doc: Column) -> Column:
    """The brackets of a document in order, those in texts left out."""
    bare = F.regexp_replace(doc, r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', "")
    return F.regexp_replace(bare, r"[^\[\]{}]+", "")


def _depth(brackets: Column) -> Column:
    """How deep they lie within each other."""
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    return F.aggregate(F.split(brackets, ""), start, _deeper, lambda s: s["most"])


def _deeper(held: Column, step: Column) -> Column:
    now = held["now"] + F.when(step.isin("[", "{"), 1).when(step.isin("]", "}"), -1).otherwise(0)
    return F.struct(now.alias("now"), F.greatest(held["most"], now).alias("most"))


def _exploded(docs: DataFrame, depth: int) -> DataFrame:
    """``path`` and ``value`` of the texts in ``doc``, one level of all documents at a time, in the JVM."""
    at = docs.select(F.lit("").alias("path"), F.try_parse_json("doc").alias("v"))
    for _ in range(depth):
        inner = at.lateralJoin(docs.sparkSession.tvf.variant_explode_outer(F.col("v").outer()))
        path = F.when(F.col("key").isNull(), F.col("path")).when(F.col("path") == "", F.col("key")).otherwise(F.concat_ws(".", "path", "key"))
        at = inner.select(path.alias("path"), F.coalesce("value", "v").alias("v"))  # what is no container stays
    return at.where(F.schema_of_variant("v") == "STRING").select("path", F.variant_get("v", "$", "string").alias("value"))


def document_leaves(df: DataFrame, column: str) -> DataFrame:
    """``path`` and ``value`` of every text in a column of documents; what is no JSON fails.

    Documents of up to ``WIDE`` bytes and ``DEEP`` levels are taken apart in the JVM. Others, and those that
    name something twice (the last one counts), go through Python one by one.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [leaf for text in part["doc"] for leaf in leaves(load(text))]
            yield pd.DataFrame(rows, columns=["path", "value"])

    docs = df.select(F.col(f"`{column}`").cast("string").alias("doc")).where(not_blank(F.col("doc")))
    short = F.octet_length("doc") <= WIDE
    shape = F.when(short & F.try_parse_json("doc").isNotNull(), _brackets(F.col("doc")))
    # documents of one shape are as deep; of the shapes only the deepest is asked for
    shapes = docs.select(shape.alias("shape")).groupBy("shape").agg(F.lit(1).alias("one"))
    deep = F.coalesce(_depth(F.col("shape")), F.lit(DEEP + 1))
    depth, others = shapes.agg(F.max(F.when(deep <= DEEP, deep)), F.count_if(deep > DEEP)).first()
    plain = F.coalesce(_depth(shape) <= DEEP, F.lit(False)) if others else F.lit(True)
    found = _exploded(docs.where(plain), depth or 0).where(not_blank(F.col("value")))
    if not others:
        return found
    return found.unionByName(docs.where(~plain).mapInPandas(run, "path string, value string"))


def path_summary(df: DataFrame, column: str, size: int = 200) -> DataFrame:
    """``path``, ``texts``, ``distinct_values``, ``average_length`` and a ``sample`` for each path."""
    cells = document_leaves(df, column).groupBy("path", "value").agg(F.count("*").alias("n"))
    sums = cells.groupBy("path").agg(F.sum("n").alias("texts"), F.count("*").alias("distinct_values"), (F.sum(F.col("n") * F.length("value")) / F.sum("n")).alias("average_length"))
    from pyspark.sql import Window

    for part in ([F.pmod(F.xxhash64("value"), F.lit(64))], []):
        w = Window.partitionBy("path", *part).orderBy(F.md5("value"), "value")
        cells = cells.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= size)
    picked = cells.groupBy("path").agg(F.sort_array(F.collect_list("value")).alias("sample"))
    return sums.join(picked, "path")


def rewrite_documents(df: DataFrame, column: str, replacements: DataFrame, paths: dict[str, str], kinds: dict[str, str] | None = None) -> DataFrame:
    """``df`` with the texts in a column of documents replaced.

    ``replacements``: ``type``, ``key`` (canonical) and ``replacement``; ``paths``: the type of each path,
    ``free_text`` for others. A text without replacement fails. Texts are taken out with their place,
    joined with the replacements by key, and put back in order, so that no dictionary goes to a worker whole.
    Equal documents are taken apart once, behind a shuffle: a batch that lies in one file is one task up to there only.
    """
    kinds = kinds or {}
    doc = F.col(f"`{column}`").cast("string")
    mark = F.when(F.trim(doc) != "", F.unhex(F.md5(doc)))  # stands for the document in joins

    def take_out(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(own, at, paths.get(p, FREE_TEXT), v) for own, text in zip(part["mark"], part["doc"], strict=True) for at, (p, v) in enumerate(leaves(load(text)))]
            yield pd.DataFrame(rows, columns=["mark", "at", "type", "value"])

    docs = df.select(mark.alias("mark"), doc.alias("doc")).where("mark is not null").distinct()
    cells = docs.mapInPandas(take_out, "mark binary, at int, type string, value string")
    key = F.lit(None).cast("string")
    for kind in sorted(set(kinds.values()) - {"Text"}):
        key = F.when(F.col("type").isin(*[t for t, k in kinds.items() if k == kind]), canonical(F.col("value"), kind)).otherwise(key)
    cells = cells.select("mark", "at", "type", F.coalesce(key, canonical(F.col("value"), "Text")).alias("key"))
    # keys come before types, which are few and tell nothing apart when rows are sorted
    cells = cells.join(replacements.select("type", "key", "replacement"), ["key", "type"], "left")
    new = F.coalesce("replacement", F.raise_error(F.concat(F.lit("no replacement for a text of type "), F.col("type"))).cast("string"))
    ordered = F.sort_array(F.collect_list(F.struct("at", new.alias("text"))))
    texts = cells.groupBy(F.col("mark").alias("__mark")).agg(F.transform(ordered, lambda x: x["text"]).alias("__texts"))

    @F.pandas_udf("string")
    def put_back(docs: pd.Series, news: pd.Series) -> pd.Series:
        out = []
        for text, own in zip(docs, news, strict=True):
            order = iter(own) if own is not None else None
            out.append(text if order is None else dump(replaced(load(text), lambda p, v, order=order: next(order))))
        return pd.Series(out, index=docs.index, dtype=object)

    # rows without a document match nothing, and are spread over the join's partitions
    apart = [f"`{f.name}`" for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    own = F.coalesce(mark, F.concat(F.lit("no "), F.xxhash64(*apart)).cast("binary"))
    out = df.withColumn("__own", own).join(texts, F.col("__own") == F.col("__mark"), "left")
    # a document without texts is returned as it is
    value = put_back(doc, F.col("__texts"))
    kind = df.schema[column].dataType
    put = F.parse_json(value) if kind.typeName() == "variant" else value.cast(kind)
    return out.select(*[put.alias(c) if c == column else F.col(f"`{c}`") for c in df.columns])
