"""Rewriting by cells: the same tables as column by column, and what their plans shuffle."""

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import cells
from palimpsest.operators.cells import bucketed, open_bucketed, rewrite_cells
from palimpsest.operators.rewrite import rewrite_table
from palimpsest.plans.model import Address, PolicyColumn
from palimpsest.registry import PACK, secret


def column(name, kind="full_name", mode="Typed", of="Text"):
    return PolicyColumn(Address("public", "t", name), "varchar", True, kind, mode, "Dictionary", canonical_kind=of)


COLUMNS = [column("a"), column("b", "city"), column("note", "free_text", "TextWipe"), column("mail", "email", of="EmailAddress")]


def rows(spark, n=400):
    k = F.col("id")
    return spark.range(n).select(
        k, F.concat(F.lit("name "), k % 50).alias("a"), F.when(k % 3 > 0, F.lit("hot town")).when(k % 7 == 0, "  ").otherwise(F.concat(F.lit("town "), k)).alias("b"),
        F.when(k % 5 > 0, F.concat(F.lit("text "), k % 9)).alias("note"), F.concat(F.when(k % 2 == 0, "X").otherwise("x"), F.lit("@"), k % 4, F.lit(".example")).alias("mail"), F.lit(1).alias("key"), F.lit(2).alias("type"),
    )


def words(spark):
    return spark.range(50).select(F.concat(F.lit("name "), "id").alias("key"), F.concat(F.lit("word "), "id").alias("replacement")).where("id % 2 = 0").unionAll(spark.createDataFrame([("hot town", "a town")], "key string, replacement string"))


@pytest.mark.parametrize("row_key", [["id"], None])
@pytest.mark.parametrize("hot", [2, 100_000_000])
def test_equals_column_by_column(spark, monkeypatch, row_key, hot):
    monkeypatch.setattr(cells, "HOT", hot)
    df, marks = rows(spark), [secret().fingerprint("name 4"), secret().fingerprint("hot town")]
    for exceptions in (None, marks):
        want = rewrite_table(df, COLUMNS, words(spark), PACK, secret(), exceptions)
        got = rewrite_cells(df, COLUMNS, bucketed(words(spark), ["key"], 3), PACK, secret(), row_key, exceptions, 3)
        assert got.dtypes == want.dtypes == df.dtypes
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_edges(spark):
    df, held = rows(spark), bucketed(words(spark), ["key"], 2)
    assert rewrite_cells(df.where("false"), COLUMNS, held, PACK, secret(), ["id"]).count() == 0
    twice = df.unionAll(df.limit(1))
    assert rewrite_cells(twice, COLUMNS, held, PACK, secret()).count() == 401
    with pytest.raises(Exception, match="several rows have one row key"):
        rewrite_cells(twice, COLUMNS, held, PACK, secret(), ["id"]).collect()
    with pytest.raises(Exception, match="no generator for type"):
        rewrite_cells(df, [column("a", "nonsense")], held, PACK, secret(), ["id"]).collect()
    with pytest.raises(ValueError, match="tell rows apart"):
        rewrite_cells(df, COLUMNS, held, PACK, secret(), ["a"])
    empty = df.select("id", F.lit(None).cast("string").alias("a"))
    assert rewrite_cells(empty, [column("a")], held, PACK, secret(), ["id"]).where("a is not null").count() == 0


def test_dictionary_kept_for_later(spark, tmp_path):
    held = bucketed(words(spark), ["key"], 3, str(tmp_path / "words"))
    again = open_bucketed(spark, str(tmp_path / "words"))
    assert again.dtypes == held.dtypes and sorted(again.collect()) == sorted(words(spark).collect())


def scans(plan):
    """(line of a scan, exchanges above it), and the number of exchanges, of a plan as text."""
    above, out, n = [], [], 0
    for line in plan.split("\n"):
        node = line.lstrip(" :+-")
        depth = len(line) - len(node)
        node = node.split(") ", 1)[-1] if node.startswith("*") else node
        above = [x for x in above if x < depth]
        if node.startswith(("Exchange", "BroadcastExchange")):
            n += node.startswith("Exchange")
            above.append(depth)
        elif node.startswith("FileScan"):
            out.append((node, len(above)))
    return out, n


@pytest.mark.parametrize(("of", "columns", "row_key"), [("orders", ["o_orderstatus", "o_orderpriority", "o_custkey"], ["o_orderkey"]), ("lineitem", ["l_returnflag", "l_linestatus", "l_partkey"], None)])
def test_one_shuffle_of_the_table_and_none_of_the_dictionary(spark, of, columns, row_key):
    """However many columns: with broadcasts off, a shuffle of cells to their words, one back, one of the table."""
    df = spark.read.parquet(f"/root/testdata/sf0.001/{of}.parquet")
    values = df.select(F.explode(F.array(*[F.col(c).cast("string") for c in columns])).alias("key")).distinct()
    held = bucketed(values.select("key", F.abs(F.xxhash64("key") % 100000).cast("string").alias("replacement")), ["key"], 4)
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(before, ("-1", "false", "4"), strict=True):
            spark.conf.set(k, v)
        counts = []
        for some in (columns[:1], columns):
            out = rewrite_cells(df, [column(c, "full_name") for c in some], held, PACK, secret(), row_key, buckets=4)
            found, n = scans(out._jdf.queryExecution().executedPlan().toString())
            counts.append(n)
            # words lie where they are, but for the few hot ones that are sent; the table is shuffled once, its cells twice
            assert sorted(above for line, above in found if "palimpsest_" in line) == [1, 3], found
            assert sorted(above for line, above in found if "palimpsest_" not in line) == [1, 2], found
        assert counts == [3, 3]
        got = out.select(*columns).collect()
        assert len(got) == df.count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_hot_cells_travel_by_number(spark):
    """Cells go back to their rows without sums before the shuffle, and a hot one as the number of its word."""
    out = rewrite_cells(rows(spark), COLUMNS[:2], bucketed(words(spark), ["key"], 2), PACK, secret(), ["id"], buckets=2)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" in plan and "partial_max" in plan[: plan.index("REPARTITION_BY_COL")] and "partial_max" not in plan[plan.index("REPARTITION_BY_COL") :]
    assert out.where("b = 'a town'").count() == rows(spark).where("b = 'hot town'").count() > 0
