"""Plain SQL dumps: blocks of ``COPY table (columns) FROM stdin;`` up to ``\\.``, read and written in parallel.

Spark splits the files by bytes. A row of a block never spans lines, so each line is told by the file, the
start of its split and its number in there. A first pass finds the lines that open and close blocks, and
counts lines; it is the only thing that reaches the driver, a few rows a table and one a split. A second
pass reads the lines of the wanted table. A block that is not closed, or a row with too few or too many
fields, stops the load with its file and line: half a table is worse than none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from palimpsest.operators.profile import as_text

OPEN = re.compile(r"COPY (?:ONLY )?(.+?) \((.*)\) FROM stdin(?: .*)?;$", re.IGNORECASE)
NAME = re.compile(r'"((?:[^"]|"")*)"|([^\s",.]+)')
#: What stands behind a backslash.
ESCAPES = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v"}
ESCAPED = re.compile(r"\\(x[0-9A-Fa-f]{1,2}|[0-7]{1,3}|.)", re.DOTALL)
#: Lines that open or close a block in all files, at most.
MARKS = 1_000_000
#: Bytes of lines taken apart at a time; their fields lie in memory several times.
PIECE = 1 << 20


class DumpError(ValueError):
    """A dump that can't be read as a whole."""


@dataclass(frozen=True)
class Block:
    """Rows between two lines of a file; a place is the start of a split and the number of a line in it."""

    file: str
    table: str
    columns: tuple[str, ...]
    opened: tuple[int, int]
    closed: tuple[int, int]


def names(text: str) -> list[str]:
    """The identifiers of a list; quotes are taken off."""
    return [(a.replace('""', '"') if quoted else b) for quoted, a, b in ((m.group(0).startswith('"'), m.group(1), m.group(2)) for m in NAME.finditer(text))]


def unescaped(text: str) -> str:
    """A field as it was before it was written: one line, no tab."""

    def one(m: re.Match) -> str:
        x = m.group(1)
        if x[0] == "x" and len(x) > 1:
            return chr(int(x[1:], 16))
        return chr(int(x, 8) & 0xFF) if x[0] in "01234567" else ESCAPES.get(x, x)

    return ESCAPED.sub(one, text) if "\\" in text else text


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``start`` (of the split), ``line`` in the order of a split."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path, lineSep="\n")
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line"))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, pa.Array]]:
    """(file, start, number of the first line in the split, lines) for runs of lines of one split."""
    held, n = None, 0
    for batch in batches:
        k = 0
        while k < batch.num_rows:
            split = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
            same = pc.and_(pc.equal(batch.column(0), split[0]), pc.equal(batch.column(1), split[1])).slice(k)
            end = same.index(pa.scalar(False)).as_py()
            size = batch.num_rows - k if end < 0 else end
            n = 0 if split != held else n
            held = split
            yield *split, n, batch.column(2).slice(k, size)
            n += size
            k += size


def _pieces(lines: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Lines in slices of about ``PIECE`` bytes (one at least), and the number of the first line in each."""
    ends, start = np.cumsum(pc.binary_length(lines).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while start < len(lines):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PIECE, "right")))
        yield start, lines.slice(start, stop - start)
        start = stop


def _marks(spark: SparkSession, path: str) -> tuple[list, dict[tuple[str, int], int]]:
    """(file, start, number, line) of the lines that may open or close a block, in order; lines by split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for file, start, first, lines in _numbered(batches):
            rows.append((file, start, first + len(lines), None))
            for k in pc.indices_nonzero(pc.or_(pc.equal(lines, "\\."), pc.match_substring_regex(lines, r"(?i)^(COPY .* FROM stdin|INSERT INTO )"))).to_pylist():
                rows.append((file, start, first + k, lines[k].as_py()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["file", "start", "number", "line"])

    found = _lines(spark, path).mapInArrow(run, "file string, start long, number long, line string")
    # a split has a row for each batch; the last one tells its lines
    found = found.groupBy("file", "start", F.when(F.col("line").isNotNull(), F.col("number")).alias("at"), "line").agg(F.max("number").alias("number"))
    rows = sorted((r["file"], r["start"], r["number"], r["line"]) for r in found.where("line is not null").limit(MARKS + 1).collect())
    if len(rows) > MARKS:
        raise DumpError(f"{path}: more than {MARKS} lines look like those that open or close a block")
    return rows, {(r["file"], r["start"]): r["number"] for r in found.where("line is null").collect()}


def _blocks(spark: SparkSession, path: str) -> tuple[list[Block], dict[tuple[str, int], int]]:
    """The blocks of all files under a path, and how many lines stand before each split in its file."""
    marks, sizes = _marks(spark, path)
    before, total = {}, {}
    for split in sorted(sizes):
        before[split] = total.get(split[0], 0)
        total[split[0]] = before[split] + sizes[split]
    out, held = [], None
    for file, start, number, line in [*marks, ("", 0, 0, None)]:
        if held is not None and held[0] != file:
            raise DumpError(f"{held[0]}: line {total[held[0]]}: the file ends within the block of {held[1]} that begins in line {before[held[0], held[3][0]] + held[3][1] + 1}")
        if held is None and line and line[:6].upper() == "INSERT":
            raise DumpError(f"{file}: line {before[file, start] + number + 1}: rows as INSERT statements are not read")
        opened = OPEN.match(line or "")
        if held is None and opened:
            held = file, ".".join(names(opened[1])), tuple(names(opened[2])), (start, number)
        elif held is not None and line == "\\.":
            out.append(Block(*held, (start, number)))
            held = None
    return out, before


def blocks(spark: SparkSession, path: str) -> list[Block]:
    """The blocks of all files under a path; one that is not closed fails."""
    return _blocks(spark, path)[0]


def tables(spark: SparkSession, path: str) -> list[str]:
    return sorted({b.table for b in blocks(spark, path)})


def read_dump(spark: SparkSession, path: str, table: str, schema: StructType | None = None) -> DataFrame:
    """One table of a dump (``schema.table``, or its bare name if only one schema has it), columns as texts or as
    those of ``schema``, by name.

    ``path`` is a file or a folder of files, each whole in itself. ``\\N`` is null. Values that don't fit
    their type fail, as casts do in Spark's ANSI mode.
    """
    every, before = _blocks(spark, path)
    wanted = [b for b in every if b.table == table] or [b for b in every if b.table.rpartition(".")[2] == table]
    if not wanted:
        raise DumpError(f"{path}: no table {table}")
    if len({b.table for b in wanted}) > 1 or len({b.columns for b in wanted}) > 1:
        raise DumpError(f"{path}: {table} stands for {', '.join(sorted({f'{b.table} ({", ".join(b.columns)})' for b in wanted}))}")
    columns, by_file = wanted[0].columns, {}
    for b in wanted:
        by_file.setdefault(b.file, []).append((b.opened, b.closed))
    before = {split: n for split, n in before.items() if split[0] in by_file}

    def taken(lines: pa.Array, file: str, number: int) -> pa.RecordBatch:
        fields = pc.split_pattern(lines, "\t")
        sizes = pc.list_value_length(fields)
        bad = pc.not_equal(sizes, len(columns)).index(pa.scalar(True)).as_py()
        if bad >= 0:
            raise DumpError(f"{file}: line {number + bad}: {sizes[bad].as_py()} fields for {len(columns)} columns of {table}")
        flat = pc.list_flatten(fields)
        flat = pc.if_else(pc.equal(flat, "\\N"), pa.scalar(None, pa.string()), flat.cast(pa.string()))
        places = pa.array(range(0, len(flat), len(columns)), pa.int64())
        made = []
        for k in range(len(columns)):
            values = flat.take(pc.add(places, k))
            if pc.any(pc.match_substring(values, "\\")).as_py():
                values = pa.array([None if v is None else unescaped(v) for v in values.to_pylist()], pa.string())
            made.append(values)
        return pa.RecordBatch.from_arrays(made, names=[f"c{k}" for k in range(len(columns))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, start, first, lines in _numbered(batches):
            for opened, closed in by_file.get(file, []):
                low = 0 if start > opened[0] else max(0, opened[1] + 1 - first) if start == opened[0] else len(lines)
                high = len(lines) if start < closed[0] else min(len(lines), closed[1] - first) if start == closed[0] else 0
                if low >= high:
                    continue
                for at, piece in _pieces(lines.slice(low, high - low)):
                    yield taken(piece, file, before[file, start] + first + low + at + 1)

    out = _lines(spark, path).mapInArrow(run, ", ".join(f"c{k} string" for k in range(len(columns))))
    if schema is None:
        return out.toDF(*columns)
    at = {c: k for k, c in enumerate(columns)}
    lost = [f.name for f in schema.fields if f.name not in at]
    if lost:
        raise DumpError(f"{path}: {table} has no column {', '.join(lost)}")
    return out.select(*[F.col(f"c{at[f.name]}").cast(f.dataType).alias(f.name) for f in schema.fields])


def _quoted(name: str) -> str:
    return name if re.fullmatch(r"[a-z_][a-z0-9_]*", name) else '"' + name.replace('"', '""') + '"'


def write_dump(df: DataFrame, path: str, table: str) -> None:
    """``df`` as text files, each a dump with a block of ``table``; files of a former run go."""
    columns = ", ".join(_quoted(c) for c in df.columns)
    head = f"COPY {'.'.join(_quoted(p) for p in table.split('.'))} ({columns}) FROM stdin;"

    def field(c: str):
        text = F.replace(as_text(df, c), F.lit("\\"), F.lit("\\\\"))
        for letter, char in ESCAPES.items():
            text = F.replace(text, F.lit(char), F.lit("\\" + letter))
        return F.coalesce(text, F.lit("\\N"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = lambda line: pa.RecordBatch.from_arrays([pa.array([line], pa.string())], names=["value"])
        yield one(head)
        for batch in batches:
            yield batch.filter(batch.column(0).is_valid())
        yield one("\\.")

    lines = df.select(F.concat_ws("\t", *[field(c) for c in df.columns]).alias("value"))
    lines = lines.unionAll(df.sparkSession.range(1).select(F.lit(None).cast("string").alias("value")))  # a block even without rows
    lines.mapInArrow(run, "value string").write.mode("overwrite").text(path, lineSep="\n")
