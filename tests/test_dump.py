"""Plain SQL dumps: what a dump says is what is read, however its file is split; a dump that is cut stops the load."""

import random

import pyarrow as pa
import pytest

from palimpsest.sources import catalog
from palimpsest.sources import dump as dump_module
from palimpsest.sources.catalog import Resource
from palimpsest.sources.dump import DumpError, blocks, names, read_dump, tables, unescaped, write_dump

HEAD = """--
-- a dump
--
SET client_encoding = 'UTF8';
CREATE TABLE public.clients (
    id bigint,
    "Full Name" text
);

"""


def dump(rows, cut=None):
    out = HEAD + 'COPY public.clients (id, "Full Name", note) FROM stdin;\n'
    out += "".join(f"{i}\t{a}\t{b}\n" for i, a, b in rows) + "\\.\n\n"
    out += "COPY other.clients (id) FROM stdin;\n\\.\n\nCOPY public.orders (id, \"to\") FROM stdin;\n" + "".join(f"{i}\t\\N\n" for i in range(50)) + "\\.\n\n-- done\n"
    return out if cut is None else out[: out.index(cut)]


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum") if spark.conf.get(k, None)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.set(k, before[k]) if k in before else spark.conf.unset(k)


def test_names_and_escapes():
    assert names('public."Odd ""name"""') == ["public", 'Odd "name"'] and names('id, "a, b", c') == ["id", "a, b", "c"]
    assert unescaped(r"a\tb\\n\n\101\x41\q\.") == "a\tb\\n\nAAq."


def test_a_split_file(spark, tmp_path, small_splits):
    random.seed(1)
    rows = [(i, r"tab\tline\nback\\slash" if i % 5 == 0 else "COPY x (a) FROM stdin;" if i % 7 == 0 else "ünï", r"\N" if i % 3 else "") for i in range(200)]
    (tmp_path / "one.sql").write_text(dump(rows))
    path = str(tmp_path / "one.sql")
    assert tables(spark, path) == ["other.clients", "public.clients", "public.orders"] and len(blocks(spark, path)) == 3
    got = read_dump(spark, path, "public.clients")
    assert got.columns == ["id", "Full Name", "note"] and got.rdd.getNumPartitions() > 4
    assert sorted(map(tuple, got.collect())) == sorted((str(i), unescaped(a), None if b == r"\N" else b) for i, a, b in rows)
    assert read_dump(spark, path, "other.clients").count() == 0
    orders = read_dump(spark, path, "orders", spark.createDataFrame([], "to string, id int").schema)
    assert sorted(r["id"] for r in orders.collect()) == list(range(50)) and orders.where("`to` is not null").count() == 0
    with pytest.raises(DumpError, match="stands for"):
        read_dump(spark, path, "clients")
    with pytest.raises(DumpError, match="no table"):
        read_dump(spark, path, "nothing")
    assert catalog.read(spark, Resource("d", "dump", path), "public.orders").count() == 50


def test_what_stops_a_load(spark, tmp_path, small_splits):
    rows = [(i, "name", "note") for i in range(100)]
    path = str(tmp_path / "bad.sql")
    whole = dump(rows)
    (tmp_path / "bad.sql").write_text(whole[: whole.index("77\tname")])
    with pytest.raises(DumpError, match=r"bad.sql: line 87: the file ends within the block of public.clients that begins in line 10"):
        read_dump(spark, path, "public.clients")
    (tmp_path / "bad.sql").write_text(whole.replace("60\tname\tnote", "60\tname"))
    with pytest.raises(Exception, match=r"bad.sql: line 71: 2 fields for 3 columns"):
        read_dump(spark, path, "public.clients").collect()
    (tmp_path / "bad.sql").write_text(whole + "INSERT INTO public.clients VALUES (1);\n")
    with pytest.raises(DumpError, match="INSERT"):
        blocks(spark, path)
    (tmp_path / "bad.sql").write_text(whole.replace("60\tname", "sixty\tname"))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        read_dump(spark, path, "public.clients", spark.createDataFrame([], "id long").schema).collect()


def test_there_and_back(spark, tmp_path):
    texts = [None, "", "\\N", "\\.", "tab\there", "line\nend\r\n", "back\\slash\\t", "\x08\x0b\x0c", "ünï 日本"]
    df = spark.createDataFrame([(i, t, i / 3, i % 2 == 0, [i]) for i, t in enumerate(texts)], 'id int, `odd "name"` string, x double, b boolean, l array<int>').repartition(3)
    for some in (df, df.where("false"), spark.createDataFrame([], df.schema)):
        write_dump(some, str(tmp_path / "t"), "s.t")
        got = read_dump(spark, str(tmp_path), "s.t", spark.createDataFrame([], 'id int, `odd "name"` string, x double, b boolean, l string').schema)
        assert sorted((r[0], r[1] or "", r[1] is None, r[2], r[3], r[4]) for r in got.collect()) == sorted((r[0], r[1] or "", r[1] is None, r[2], r[3], f"[{r[0]}]") for r in some.collect())


def test_lines_are_taken_apart_in_pieces(spark, tmp_path):
    """However many lines come at a time, a megabyte of them is taken apart; a bad one is still told by its line."""
    lines = pa.array(["x" * random.randint(0, 3000) for _ in range(3000)] + ["y" * 3_000_000, "z"])
    parts = list(dump_module._pieces(lines.slice(1)))
    assert pa.concat_arrays([p for _, p in parts]).equals(lines.slice(1))
    assert [at for at, _ in parts] == [sum(len(p) for _, p in parts[:k]) for k in range(len(parts))]
    assert len(parts) > 5 and all(len(p) == 1 or sum(map(len, p.to_pylist())) <= dump_module.PIECE for _, p in parts)
    rows = [(i, "a" * 900, r"b\nc") for i in range(4000)]
    (tmp_path / "x.sql").write_text(dump(rows))
    assert read_dump(spark, str(tmp_path / "x.sql"), "public.clients").where("note = 'b\\nc'").count() == 4000
    (tmp_path / "y.sql").write_text(dump([*rows[:3000], (3000, "a", "b\tc"), *rows[3001:]]))
    with pytest.raises(Exception, match="line 3011: 4 fields for 3 columns"):
        read_dump(spark, str(tmp_path / "y.sql"), "public.clients").collect()
