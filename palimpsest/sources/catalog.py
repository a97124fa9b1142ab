"""Sources and sinks by name: Parquet, ORC, JSON, CSV, JDBC, plain SQL dumps, and dumps (told apart by content)."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, DataFrameReader, SparkSession

from .dump import read_dump, write_dump

FORMATS = ("parquet", "orc", "json", "csv", "jdbc")
#: First bytes of file formats.
MAGIC = {b"PAR1": "parquet", b"ORC": "orc"}
#: How plain SQL dumps begin.
STATEMENTS = (b"--", b"COPY ", b"SET ", b"CREATE ", b"BEGIN;")


@dataclass
class Resource:
    """A source or sink: ``kind`` (a format, or ``dump``), its path or connection, and options."""

    id: str
    kind: str
    path: str = ""
    connection: str = ""
    title: str = ""
    options: dict[str, str] = field(default_factory=dict)

    def check(self) -> None:
        if self.kind not in (*FORMATS, "dump", "sql"):
            raise ValueError(f"{self.id}: unknown kind {self.kind}")
        if self.kind == "jdbc" and not self.connection:
            raise ValueError(f"{self.id}: a database needs a connection")
        if self.kind != "jdbc" and not self.path:
            raise ValueError(f"{self.id}: a {self.kind} needs a path")


def expand(text: str, env: dict[str, str] | None = None) -> str:
    """``${NAME}`` replaced by variables; an unset one raises KeyError."""
    env = dict(os.environ) if env is None else env
    return re.sub(r"\$\{(\w+)\}", lambda m: env[m[1]], text)


@dataclass
class Catalog:
    sources: dict[str, Resource]
    sinks: dict[str, Resource]
    skipped: list[str]

    @classmethod
    def load(cls, text: str, env: dict[str, str] | None = None) -> Catalog:
        """A catalog from JSON with ``sources`` and ``sinks``. Entries with unset variables are left out
        and reported; a side without any entry left is an error."""
        raw, skipped = json.loads(text), []
        sides: dict[str, dict[str, Resource]] = {}
        for side in ("sources", "sinks"):
            sides[side] = {}
            for entry in raw.get(side, []):
                try:
                    values = {k: {a: expand(b, env) for a, b in v.items()} if isinstance(v, dict) else expand(v, env) for k, v in entry.items()}
                except KeyError as e:
                    skipped.append(f"{entry.get('id')}: variable {e.args[0]} is not set")
                    continue
                resource = Resource(**values)
                resource.check()
                sides[side][resource.id] = resource
            if not sides[side]:
                raise ValueError(f"no usable entry in {side}: {'; '.join(skipped)}")
        return cls(sides["sources"], sides["sinks"], skipped)

    def source(self, name: str) -> Resource:
        return self._named(self.sources, name)

    def sink(self, name: str) -> Resource:
        return self._named(self.sinks, name)

    @staticmethod
    def _named(side: dict[str, Resource], name: str) -> Resource:
        if name not in side:
            raise KeyError(f"unknown {name!r}; known: {', '.join(sorted(side))}")
        return side[name]


def jdbc_url(dsn: str) -> tuple[str, dict[str, str]]:
    """A PostgreSQL JDBC address and properties from ``Host=..;Port=..;Database=..;Username=..;Password=..``.

    Values may stand in quotes, in which a doubled quote is one.
    """
    pairs = re.findall(r"\s*([^=;]+?)\s*=\s*(?:\"((?:[^\"]|\"\")*)\"|'((?:[^']|'')*)'|([^;]*))\s*(?:;|$)", dsn)
    values = {k.lower().replace(" ", ""): (a.replace('""', '"') or b.replace("''", "'") or c.strip()) for k, a, b, c in pairs}
    host, database = values.get("host") or values.get("server"), values.get("database")
    if not host or not database:
        raise ValueError("a connection names host and database")
    properties = {"user": values.get("username") or values.get("userid") or "", "password": values.get("password", ""), "driver": "org.postgresql.Driver"}
    return f"jdbc:postgresql://{host}:{values.get('port', '5432')}/{database}", {k: v for k, v in properties.items() if v}


def libpq(dsn: dict[str, str]) -> str:
    """Keyword form of a connection for command-line tools, values quoted and escaped."""

    def quoted(v: str) -> str:
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"

    return " ".join(f"{k}={quoted(v)}" for k, v in dsn.items())


def sniff(spark: SparkSession, path: str) -> str:
    """The format of the files under a path, by their first bytes (read by Spark, on any file system)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    names = [r["path"] for r in files.select("path").limit(1000).collect() if not os.path.basename(r["path"]).startswith(("_", "."))]
    if not names:
        raise ValueError(f"nothing to read in {path}")
    head = _first_bytes(spark, names[0])
    for magic, kind in MAGIC.items():
        if head.startswith(magic):
            return kind
    if head.upper().startswith(STATEMENTS):
        return "sql"
    return "json" if head.lstrip()[:1] in (b"{", b"[") else "csv"


def _first_bytes(spark: SparkSession, path: str, n: int = 16) -> bytes:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        out = bytearray()
        while len(out) < n and (b := stream.read()) >= 0:
            out.append(b)
        return bytes(out)
    finally:
        stream.close()


def read(spark: SparkSession, source: Resource, table: str, schema=None) -> DataFrame:
    """One table of a source: ``<path>/<table>`` (with or without the format's suffix), or ``schema.table``."""
    source.check()
    if source.kind == "jdbc":
        url, properties = jdbc_url(source.connection) if not source.connection.startswith("jdbc:") else (source.connection, {})
        return spark.read.format("jdbc").options(url=url, dbtable=table, **properties, **source.options).load()
    if source.kind == "sql" or source.kind == "dump" and _is_sql(spark, source.path):
        return read_dump(spark, source.path, table, schema)
    reader: DataFrameReader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    path = f"{source.path.rstrip('/')}/{table}"
    kind = sniff(spark, _existing(spark, path, "")) if source.kind == "dump" else source.kind
    options = {"header": "true"} | source.options if kind == "csv" else source.options
    return reader.format(kind).options(**options).load(_existing(spark, path, kind))


def _is_sql(spark: SparkSession, path: str) -> bool:
    """A file, or a folder of files, that is a plain SQL dump."""
    return sniff(spark, path) == "sql"


def _existing(spark: SparkSession, path: str, kind: str) -> str:
    for name in dict.fromkeys((path, f"{path}.{kind}", *(f"{path}.{k}" for k in FORMATS))):
        at = spark._jvm.org.apache.hadoop.fs.Path(name)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return name
    raise ValueError(f"no such table: {path}")


def write(df: DataFrame, sink: Resource, table: str) -> None:
    """Replaces a table of a sink; nothing of a former run stays."""
    sink.check()
    if sink.kind == "jdbc":
        url, properties = jdbc_url(sink.connection) if not sink.connection.startswith("jdbc:") else (sink.connection, {})
        df.write.format("jdbc").mode("overwrite").options(url=url, dbtable=table, **properties, **sink.options).save()
        return
    if sink.kind == "sql":
        write_dump(df, f"{sink.path.rstrip('/')}/{table}", table)
        return
    kind = "parquet" if sink.kind == "dump" else sink.kind
    options = {"header": "true"} | sink.options if kind == "csv" else sink.options
    df.write.mode("overwrite").format(kind).options(**options).save(f"{sink.path.rstrip('/')}/{table}")


def latest(names: list[str]) -> str:
    """The last of the dumps' names, by code points."""
    if not names:
        raise ValueError("no dump")
    return max(names)
