"""Descriptions of tables: columns with types, keys, comments and finite domains, and their fingerprint.

Files carry no constraints, so a sidecar names them; what it leaves out can be inferred from the data.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.plans.model import Address, Features


@dataclass
class Constraints:
    """A table's sidecar: keys as lists of columns, foreign keys by column, CHECK definitions, comments."""

    primary_key: list[str] = field(default_factory=list)
    unique: list[list[str]] = field(default_factory=list)
    foreign_keys: dict[str, str] = field(default_factory=dict)
    checks: dict[str, str] = field(default_factory=dict)
    comments: dict[str, str] = field(default_factory=dict)
    types: dict[str, str] = field(default_factory=dict)


def domain_literals(definition: Column) -> Column:
    """The values that a CHECK of the form ``= ANY (ARRAY['a'::text, ...])`` or ``column IN ('a', ...)`` lists; empty
    for other checks.

    A doubled quote within a value is one quote.
    """
    typed = F.regexp_extract_all(definition, F.lit("'((?:[^']|'')*)'::"), F.lit(1))
    plain = F.regexp_extract_all(definition, F.lit("'((?:[^']|'')*)'"), F.lit(1))
    text = "'(?:[^']|'')*'"
    listed = definition.rlike(rf'(?i)^[(\s]*"?\w+"?\s+IN\s*\(\s*{text}(?:\s*,\s*{text})*\s*\)[)\s]*$')
    found = F.when(definition.contains("ANY"), typed).when(listed, plain).otherwise(F.array().cast("array<string>"))
    return F.transform(found, lambda v: F.replace(v, F.lit("''"), F.lit("'")))


def describe(df: DataFrame, schema: str, table: str, constraints: Constraints | None = None) -> list[Features]:
    """Features of all columns, without those that need the data, in the columns' order."""
    c = constraints or Constraints()
    domains: dict[str, list[str]] = {}
    if c.checks:
        spark = df.sparkSession
        rows = spark.createDataFrame(sorted(c.checks.items()), "name string, definition string")
        domains = {r["name"]: r["values"] for r in rows.select("name", domain_literals(F.col("definition")).alias("values")).collect()}
    unique = {name for key in c.unique for name in key} | set(c.primary_key)
    return [
        Features(
            Address(schema, table, f.name), c.types.get(f.name, f.dataType.simpleString()), c.comments.get(f.name, f.metadata.get("comment", "")), f.nullable,
            f.name in c.primary_key, f.name in unique, f.name in c.foreign_keys, domains.get(f.name, []),
        )
        for f in df.schema.fields
    ]


def catalog_constraints(keys: DataFrame, indexes: DataFrame, checks: DataFrame, comments: DataFrame) -> dict[str, Constraints]:
    """Sidecars of a database's tables from its catalog.

    ``keys``: ``table_name``, ``kind`` (p, u or f), ``columns`` (array) and ``target`` (of a foreign key,
    ``table.column``); ``indexes``: ``table_name`` and ``columns`` of unique indexes; ``checks``:
    ``table_name``, ``columns`` and ``definition``; ``comments``: ``table_name``, ``column_name`` and
    ``comment``. A unique index is a unique key; a key of one column listed twice counts once; checks of
    several columns restrict none by itself.
    """
    every = keys.select("table_name", "kind", "columns", "target").unionByName(indexes.select("table_name", F.lit("u").alias("kind"), "columns", F.lit("").alias("target"))).distinct()
    out: dict[str, Constraints] = {}
    for r in every.orderBy("table_name", "kind", "columns").collect():  # a schema's constraints, not its data
        c = out.setdefault(r["table_name"], Constraints())
        if r["kind"] == "p":
            c.primary_key = list(r["columns"])
        elif r["kind"] == "u":
            c.unique.append(list(r["columns"]))
        elif len(r["columns"]) == 1:
            c.foreign_keys[r["columns"][0]] = r["target"]
    for r in checks.where(F.size("columns") == 1).select("table_name", F.col("columns")[0].alias("column"), "definition").collect():
        out.setdefault(r["table_name"], Constraints()).checks[r["column"]] = r["definition"]
    for r in comments.where("comment <> ''").collect():
        out.setdefault(r["table_name"], Constraints()).comments[r["column_name"]] = r["comment"]
    return out


#: Questions to PostgreSQL's catalog whose answers ``catalog_constraints`` takes; ``{schema}`` is filled in.
POSTGRES = {
    "keys": """SELECT t.relname AS table_name, CAST(c.contype AS text) AS kind, ARRAY(SELECT CAST(a.attname AS text) FROM unnest(c.conkey) k JOIN pg_attribute a ON a.attrelid = t.oid AND a.attnum = k) AS columns,
 coalesce((SELECT r.relname || '.' || a.attname FROM pg_class r JOIN pg_attribute a ON a.attrelid = r.oid WHERE r.oid = c.confrelid AND a.attnum = c.confkey[1]), '') AS target
 FROM pg_constraint c JOIN pg_class t ON t.oid = c.conrelid JOIN pg_namespace n ON n.oid = t.relnamespace WHERE n.nspname = '{schema}' AND c.contype IN ('p', 'u', 'f')""",
    "indexes": """SELECT t.relname AS table_name, ARRAY(SELECT CAST(a.attname AS text) FROM pg_attribute a WHERE a.attrelid = t.oid AND a.attnum = ANY (i.indkey)) AS columns
 FROM pg_index i JOIN pg_class t ON t.oid = i.indrelid JOIN pg_namespace n ON n.oid = t.relnamespace WHERE n.nspname = '{schema}' AND i.indisunique AND i.indpred IS NULL""",
    "checks": """SELECT t.relname AS table_name, ARRAY(SELECT CAST(a.attname AS text) FROM unnest(c.conkey) k JOIN pg_attribute a ON a.attrelid = t.oid AND a.attnum = k) AS columns, pg_get_constraintdef(c.oid) AS definition
 FROM pg_constraint c JOIN pg_class t ON t.oid = c.conrelid JOIN pg_namespace n ON n.oid = t.relnamespace WHERE n.nspname = '{schema}' AND c.contype = 'c'""",
    "comments": """SELECT t.relname AS table_name, CAST(a.attname AS text) AS column_name, coalesce(col_description(t.oid, a.attnum), '') AS comment
 FROM pg_attribute a JOIN pg_class t ON t.oid = a.attrelid JOIN pg_namespace n ON n.oid = t.relnamespace WHERE n.nspname = '{schema}' AND a.attnum > 0 AND NOT a.attisdropped""",
}


def jdbc_constraints(spark: SparkSession, url: str, properties: dict[str, str], schema: str = "public") -> dict[str, Constraints]:
    """Sidecars of all tables of a PostgreSQL schema, asked for through Spark's JDBC source."""
    if not schema.replace("_", "").isalnum():
        raise ValueError(f"no schema name: {schema}")
    answers = {name: spark.read.format("jdbc").options(url=url, query=sql.format(schema=schema), **properties).load() for name, sql in POSTGRES.items()}
    return catalog_constraints(**answers)


def unique_columns(df: DataFrame) -> list[str]:
    """Columns whose values are all present and different: candidates for keys."""
    from palimpsest.operators.profile import aggregates

    found = aggregates(df, exact=True).where("rows > 0 and non_null = rows and distinct_values = rows")
    return sorted(r["column"] for r in found.collect())


def fingerprint_lines(features: list[Features]) -> list[str]:
    return sorted("|".join([f.address.qualified, f.data_type, "null" if f.nullable else "not null", "p" * f.is_primary_key + "u" * f.is_unique + "f" * f.is_foreign_key, f.comment, ",".join(f.finite_domain)]) for f in features)


def schema_fingerprint(features: list[Features]) -> str:
    """SHA-256 of all columns' descriptions, whatever their order."""
    return hashlib.sha256("\n".join(fingerprint_lines(features)).encode()).hexdigest()


def simple_keys(features: list[Features]) -> dict[str, list[str]]:
    """The primary key of each table that has one."""
    out: dict[str, list[str]] = {}
    for f in features:
        if f.is_primary_key:
            out.setdefault(f"{f.address.schema}.{f.address.table}", []).append(f.address.column)
    return out


def estimated_rows(df: DataFrame) -> int:
    """Rows by the plan's statistics, 0 where there are none."""
    found = df._jdf.queryExecution().optimizedPlan().stats().rowCount()
    return int(str(found.get())) if found.isDefined() else 0


def list_columns(spark: SparkSession, tables: dict[str, DataFrame], schema: str) -> DataFrame:
    """``table_schema``, ``table_name``, ``column_name``, ``ordinal``, ``data_type`` of tables."""
    rows = [(schema, t, f.name, i, f.dataType.simpleString()) for t, df in sorted(tables.items()) for i, f in enumerate(df.schema.fields, 1)]
    return spark.createDataFrame(rows, "table_schema string, table_name string, column_name string, ordinal int, data_type string")
