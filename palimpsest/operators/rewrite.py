"""Rewriting tables: every planned column by its dictionary or function, all others as they are."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.canonical import canonical
from palimpsest.functions.prf import Secret, fingerprint, index_hex
from palimpsest.functions.validators import VALIDATORS
from palimpsest.plans.model import FREE_TEXT, Address, PolicyColumn
from palimpsest.plans.planner import Plan
from palimpsest.plans.rulepack import RulePack
from palimpsest.plans.storage import stage_table

from .cells import rewrite_cells
from .dictionary import bijection, domain_values, function_replacement, merged, permutation
from .document import document_leaves, rewrite_documents
from .generators import Renderers

#: Rendered values that a type's pool is tested with before a run.
PREFLIGHT = 256


def preflight(plan: Plan, pack: RulePack, spark: SparkSession) -> list[str]:
    """What would go wrong, before anything is written: missing generators or validators, bad pools."""
    import numpy as np

    from palimpsest.functions.validators import valid

    renderers, out = Renderers(pack), []
    types = set()
    for columns in plan.tables.values():
        for c in columns:
            if c.mode == "TextSpot":
                out.append(f"{c.address.qualified}: replacing spots within a text is not supported")
            elif c.mode == "Document":
                types |= {*c.document_paths.values(), FREE_TEXT}
            elif c.strategy != "Derangement":
                types.add(FREE_TEXT if c.mode == "TextWipe" else c.semantic_type)
    for t in sorted(types):
        if not renderers.supports(t):
            out.append(f"{t}: no generator")
        elif t not in VALIDATORS:
            out.append(f"{t}: no validator")
        else:
            indexes = np.arange(PREFLIGHT, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            pool = spark.createDataFrame([(v,) for v in renderers.render(t, indexes)], "value string")
            bad = pool.where(~valid(F.col("value"), t)).limit(10).collect()
            if bad:
                out.append(f"{t}: the pool has values that are not plausible, such as {bad[0]['value']!r}")
    return out


def build_dictionary(plan: Plan, tables: Callable[[Address], DataFrame], pack: RulePack, secret: Secret) -> DataFrame:
    """``type``, ``key``, ``replacement`` for all domains of a plan.

    A value that stands in several domains belongs to the most specific type, so that it has one
    replacement everywhere.
    """
    parts: list[DataFrame] = []
    taken: DataFrame | None = None
    ranked = sorted(plan.domains, key=lambda d: (not d.constrained, pack.registry.ranks.get(d.semantic_type, 1 << 62), d.semantic_type))
    for domain in ranked:
        keys = domain_values([(tables(c.address), c.address.column, c.canonical_kind) for c in domain.members])
        if domain.constrained:
            part = permutation(keys, domain.semantic_type, domain.allowed, secret)
        else:
            if taken is not None:
                keys = keys.join(taken, "key", "left_anti")
            part = bijection(keys, domain.semantic_type, pack, secret)
        part = part.withColumn("type", F.lit(domain.semantic_type))
        parts.append(part)
        taken = part.select("key") if taken is None else taken.unionByName(part.select("key"))
    if not parts:
        spark = SparkSession.getActiveSession()
        return spark.createDataFrame([], "key string, replacement string, type string")
    return merged(parts)


def resolve(keys: DataFrame, semantic_type: str, dictionary: DataFrame, pack: RulePack, secret: Secret, exceptions: list[str] | None = None, cross_types: DataFrame | None = None) -> DataFrame:
    """``key`` and ``replacement`` for different canonical values (column ``key``) of a column of a type.

    An exception (listed by fingerprint) is replaced within the column's own type under a key of its
    own. Else the dictionary's word holds; else the function's, with the value's type from
    ``cross_types`` (``value``, ``type``) where that lists it.
    """
    at = secret.keyed(keys.select("key")).withColumn("label", F.lit(""))
    if exceptions:
        listed = keys.sparkSession.createDataFrame([(e,) for e in sorted(set(exceptions))], "mark string").withColumn("excepted", F.lit(True))
        at = at.withColumn("mark", fingerprint(F.col("key"))).join(listed, "mark", "left")
        at = at.withColumn("label", F.when(F.col("excepted"), F.lit(semantic_type)).otherwise(""))
    at = at.select("key", "label", index_hex(F.col("key"), F.col("label")).alias("index"))
    at = at.join(dictionary.select("key", F.col("replacement").alias("listed")), "key", "left")
    at = at.withColumn("listed", F.when(F.col("label") == "", F.col("listed")))
    at = at.withColumn("type", F.lit(semantic_type))
    types = {semantic_type}
    if cross_types is not None:
        cross_types = stage_table(cross_types.select(F.col("value").alias("key"), F.col("type").alias("other")), "types")
        types |= {r["other"] for r in cross_types.select("other").distinct().collect()}
        at = at.join(cross_types, "key", "left").withColumn("type", F.when(F.col("label") == "", F.coalesce("other", "type")).otherwise(F.col("type")))
    made: Column = F.raise_error(F.concat(F.lit("no generator for type "), F.col("type"))).cast("string")
    renderers = Renderers(pack)
    for t in sorted(types):
        if renderers.supports(t):
            # only values without an entry are rendered
            index = F.when(F.col("listed").isNull() & (F.col("type") == t), F.col("index"))
            made = F.when(F.col("type") == t, function_replacement(F.col("key"), index, t, pack)).otherwise(made)
    return at.select("key", F.coalesce("listed", made).alias("replacement"))


def rewrite_column(df: DataFrame, column: PolicyColumn, dictionary: DataFrame, pack: RulePack, secret: Secret, exceptions: list[str] | None = None, base: DataFrame | None = None) -> DataFrame:
    """``df`` with one column rewritten; nulls and blanks stay, everything else is replaced or fails.

    Different values are resolved once and joined back; Spark broadcasts the small side by its size.
    ``base`` is a table with the column as it was, if ``df`` has been rewritten before: its values come
    from there, and no plan holds another's.
    """
    name = column.address.column
    if column.mode == "Document":
        return _rewrite_document(df, column, dictionary, pack, secret, exceptions)
    if column.mode == "TextSpot":
        raise ValueError(f"{column.address.qualified}: replacing spots within a text is not supported")
    semantic_type = FREE_TEXT if column.mode == "TextWipe" else column.semantic_type
    kind = "Text" if column.mode == "TextWipe" else column.canonical_kind
    key = canonical(F.col(f"`{name}`"), kind)
    keys = (df if base is None else base).select(key.alias("key")).where("key is not null").distinct()
    found = resolve(keys, semantic_type, dictionary, pack, secret, exceptions).withColumnsRenamed({"key": "__key", "replacement": "__replacement"})
    # rows without a key match nothing; a hash of the row spreads them over the join's partitions
    apart = [f"`{f.name}`" for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    spread = F.coalesce(F.col("__own"), F.concat(F.lit("\0"), F.xxhash64(*apart)))
    out = df.withColumn("__own", key).withColumn("__at", spread).join(found, F.col("__at") == F.col("__key"), "left")
    value = F.coalesce("__replacement", F.raise_error(F.lit(f"{column.address.qualified}: a value without replacement")).cast("string"))
    new = F.when(F.col("__own").isNull(), F.col(f"`{name}`")).otherwise(value.cast(df.schema[name].dataType))
    return out.select(*[new.alias(c) if c == name else F.col(f"`{c}`") for c in df.columns])


def _rewrite_document(df: DataFrame, column: PolicyColumn, dictionary: DataFrame, pack: RulePack, secret: Secret, exceptions: list[str] | None) -> DataFrame:
    name = column.address.column
    kinds = {r.semantic_type: r.canonical_kind for r in pack.rules}
    texts = document_leaves(df, name)
    parts = []
    for t in sorted({*column.document_paths.values(), FREE_TEXT}):
        own = [p for p, of in column.document_paths.items() if of == t]
        here = F.col("path").isin(*own) if own else F.lit(False)
        if t == FREE_TEXT:
            here = here | ~F.col("path").isin(*column.document_paths) if column.document_paths else F.lit(True)
        keys = texts.where(here).select(canonical(F.col("value"), kinds.get(t, "Text")).alias("key")).where("key is not null").distinct()
        parts.append(resolve(keys, t, dictionary, pack, secret, exceptions).withColumn("type", F.lit(t)))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return rewrite_documents(df, name, found, column.document_paths, kinds)


def rewrite_table(df: DataFrame, columns: list[PolicyColumn], dictionary: DataFrame, pack: RulePack, secret: Secret, exceptions: list[str] | None = None, counts: Observation | None = None, row_key: list[str] | None = None, by_cells: bool = False) -> DataFrame:
    """All planned columns of a table; names, order and types of columns stay.

    ``by_cells``: whole values are rewritten together by ``rewrite_cells`` (``row_key`` tells it rows apart),
    the way for dictionaries and tables too large to be sent or shuffled once a column.
    ``counts`` observes the rows and, by column, how many cells are replaced; the others have no key and
    stay. It holds its figures once the result has been written.
    """
    base = df
    if counts is not None:
        typed = [c for c in columns if c.mode != "Document"]
        keys = [canonical(F.col(f"`{c.address.column}`"), "Text" if c.mode == "TextWipe" else c.canonical_kind) for c in typed]
        df = df.observe(counts, F.count(F.lit(1)).alias("rows"), *[F.count(k).alias(c.address.column) for k, c in zip(keys, typed, strict=True)])
    whole = [c for c in columns if by_cells and c.mode in ("Typed", "TextWipe")]
    df = rewrite_cells(df, whole, dictionary, pack, secret, row_key, exceptions)
    for column in (c for c in columns if c not in whole):
        df = rewrite_column(df, column, dictionary, pack, secret, exceptions, base)
    return df
