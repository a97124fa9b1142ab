"""Queries over whole tables: rewriting by cells, SQL dumps, rows that go with their parents, a database,
a stream of documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.cells import bucketed
from palimpsest.operators.closure import ForeignKey, losses
from palimpsest.operators.document import rewrite_documents
from palimpsest.operators.rewrite import rewrite_table
from palimpsest.plans.model import Address, PolicyColumn
from palimpsest.plans.storage import stage_table, work_dir
from palimpsest.registry import ORACLE_SQL, PACK, query, secret, table
from palimpsest.sources import catalog, database
from palimpsest.sources.catalog import Resource
from palimpsest.streaming.rewrite import start_batches, written_batches


def _digested(df: DataFrame, texts: list[str], number: str) -> DataFrame:
    """``df`` with texts replaced by their digest and a number by seven times it and three, by cells."""
    words = df.select(F.explode(F.array(*texts)).alias("key")).select("key", F.md5("key").alias("replacement"))
    words = words.unionAll(df.select(F.col(number).cast("string").alias("key"), (F.col(number) * 7 + 3).cast("string").alias("replacement"))).distinct()
    columns = [PolicyColumn(Address("public", "t", c), "varchar", True, "full_name", "Typed", "Dictionary") for c in [*texts, number]]
    return rewrite_table(df, columns, bucketed(words, ["key"]), PACK, secret(), row_key=["o_orderkey"] if "o_orderkey" in df.columns else None, by_cells=True)


@query("SELECT * REPLACE (md5(o_orderstatus) AS o_orderstatus, md5(o_orderpriority) AS o_orderpriority, o_custkey * 7 + 3 AS o_custkey) FROM orders")
def rewrite_orders_by_cells(spark, sf_dir):
    """Three columns of a table with a key, by one shuffle of the table."""
    return _digested(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"], "o_custkey")


@query("SELECT * REPLACE (md5(l_returnflag) AS l_returnflag, md5(l_linestatus) AS l_linestatus, l_partkey * 7 + 3 AS l_partkey) FROM lineitem")
def rewrite_lineitem_by_cells(spark, sf_dir):
    """Three columns of a table without a key, two of them with few values that each fill a third of the rows or more."""
    return _digested(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_partkey")


def _dumped(spark, sf_dir, of: str) -> DataFrame:
    """Three tables as one plain dump, of which one is read back."""
    sink = Resource("dump", "sql", f"{work_dir(spark)}/dump-{uuid.uuid4().hex}")
    for name in ("customer", "orders", "documents"):
        catalog.write(table(spark, sf_dir, name), sink, name)
    return catalog.read(spark, Resource("dump", "dump", sink.path), of, table(spark, sf_dir, of).schema)


@query("SELECT * FROM customer")
def dump_customer(spark, sf_dir):
    return _dumped(spark, sf_dir, "customer")


@query("SELECT * FROM orders")
def dump_orders(spark, sf_dir):
    return _dumped(spark, sf_dir, "orders")


@query("SELECT doc_id, text, lang FROM documents")
def dump_documents(spark, sf_dir):
    """Texts with line ends, tabs and backslashes."""
    return _dumped(spark, sf_dir, "documents").select("doc_id", "text", "lang")


KEYS = [
    ForeignKey("nation", ("n_regionkey",), "region", ("r_regionkey",)), ForeignKey("customer", ("c_nationkey",), "nation", ("n_nationkey",)),
    ForeignKey("supplier", ("s_nationkey",), "nation", ("n_nationkey",)), ForeignKey("orders", ("o_custkey",), "customer", ("c_custkey",)),
    ForeignKey("lineitem", ("l_orderkey",), "orders", ("o_orderkey",)), ForeignKey("lineitem", ("l_suppkey",), "supplier", ("s_suppkey",)),
]
GONE = {"region": "r_regionkey % 10 = 3", "customer": "c_custkey % 10 = 0", "orders": "o_orderkey % 10 = 7"}


@query(f"""
WITH RECURSIVE gone(t, k) AS (
  SELECT t, k FROM (SELECT 'region' AS t, r_regionkey AS k FROM region WHERE {GONE['region']} UNION SELECT 'customer', c_custkey FROM customer WHERE {GONE['customer']} UNION SELECT 'orders', o_orderkey FROM orders WHERE {GONE['orders']})
  UNION SELECT links.t, links.k FROM gone JOIN (
    SELECT 'nation' AS t, n_nationkey AS k, 'region' AS p, n_regionkey AS u FROM nation UNION ALL SELECT 'customer', c_custkey, 'nation', c_nationkey FROM customer
    UNION ALL SELECT 'supplier', s_suppkey, 'nation', s_nationkey FROM supplier UNION ALL SELECT 'orders', o_orderkey, 'customer', o_custkey FROM orders
  ) links ON links.p = gone.t AND links.u = gone.k
) SELECT t AS table_name, count(*) AS lost, CAST(sum(k) AS BIGINT) AS key_sum FROM gone GROUP BY t
UNION ALL SELECT 'lineitem', count(*), CAST(sum(l_orderkey) AS BIGINT) FROM lineitem WHERE l_orderkey IN (SELECT k FROM gone WHERE t = 'orders') OR l_suppkey IN (SELECT k FROM gone WHERE t = 'supplier')
""")
def lost_with_parents(spark, sf_dir):
    """Rows of all tables that go with a region, a tenth of the customers and a tenth of the orders."""
    names = ["region", "nation", "customer", "supplier", "orders", "lineitem"]
    tables = {t: table(spark, sf_dir, t) for t in names}
    found = losses(tables, KEYS, {t: tables[t].where(test) for t, test in GONE.items()})
    key = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "orders": "o_orderkey", "lineitem": "l_orderkey"}
    parts = [found.rows(t).agg(F.lit(t).alias("table_name"), F.count("*").alias("lost"), F.sum(key[t]).cast("long").alias("key_sum")) for t in names]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


#: Tables of a database with constraints; Derby is part of Spark.
MADE = [
    'CREATE TABLE "nation" ("n_nationkey" INT NOT NULL PRIMARY KEY, "n_name" VARCHAR(60) UNIQUE NOT NULL, "n_regionkey" INT)',
    'CREATE TABLE "customer" ("c_custkey" BIGINT NOT NULL PRIMARY KEY, "c_name" VARCHAR(60), "c_nationkey" INT REFERENCES "nation" ("n_nationkey"), "c_acctbal" DOUBLE, "c_mktsegment" VARCHAR(20))',
    """CREATE TABLE "orders" ("o_orderkey" BIGINT NOT NULL PRIMARY KEY, "o_custkey" BIGINT REFERENCES "customer" ("c_custkey"), "o_orderstatus" VARCHAR(1) CHECK ("o_orderstatus" IN ('F', 'O', 'P')), "o_totalprice" DOUBLE, "o_orderpriority" VARCHAR(20))""",
]


def _database(spark, sf_dir):
    """The tables of a database within this process, filled through Spark: local sessions only."""
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("executors of a cluster do not reach a database within the driver")
    url = f"jdbc:derby:memory:x{uuid.uuid4().hex};create=true"
    with database.Connection(spark, url, {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}) as db:
        db.execute(*MADE)
    for name, columns in (("nation", None), ("customer", None), ("orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"])):
        df = table(spark, sf_dir, name)
        df = df.select(*(columns or df.columns))
        df.write.format("jdbc").mode("append").options(url=url, dbtable=f'"{name}"', driver="org.apache.derby.iapi.jdbc.AutoloadedDriver").save()
    return database.load(spark, url, {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}, "APP", 4)


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def database_orders(spark, sf_dir):
    """A table of a database, read in four parts."""
    return _database(spark, sf_dir).tables["orders"]


@query("""
SELECT c_custkey, c_name, n_name, o.n, o.cents FROM customer JOIN nation ON n_nationkey = c_nationkey
JOIN (SELECT o_custkey, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey WHERE c_custkey % 2 = 0
""")
def database_joined(spark, sf_dir):
    """Three tables of a database, with filters that go there."""
    db = _database(spark, sf_dir).tables
    sums = db["orders"].groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))
    found = db["customer"].where("c_custkey % 2 = 0").join(db["nation"], F.col("c_nationkey") == F.col("n_nationkey")).join(sums, F.col("c_custkey") == F.col("o_custkey"))
    return found.select("c_custkey", "c_name", "n_name", "n", "cents")


@query("""
WITH d(table_name, column_name, is_primary_key, is_unique, is_foreign_key, listed) AS (VALUES
  ('nation', 'n_nationkey', true, true, false, ''), ('nation', 'n_name', false, true, false, ''), ('nation', 'n_regionkey', false, false, false, ''),
  ('customer', 'c_custkey', true, true, false, ''), ('customer', 'c_name', false, false, false, ''), ('customer', 'c_nationkey', false, false, true, ''), ('customer', 'c_acctbal', false, false, false, ''), ('customer', 'c_mktsegment', false, false, false, ''),
  ('orders', 'o_orderkey', true, true, false, ''), ('orders', 'o_custkey', false, false, true, ''), ('orders', 'o_orderstatus', false, false, false, 'F,O,P'), ('orders', 'o_totalprice', false, false, false, ''), ('orders', 'o_orderpriority', false, false, false, '')
), n AS (SELECT 'nation' AS table_name, count(*) AS rows FROM nation UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'orders', count(*) FROM orders)
SELECT d.*, rows FROM d JOIN n USING (table_name)
""")
def database_description(spark, sf_dir):
    """What the database says of its columns, and how many rows its tables have."""
    db = _database(spark, sf_dir)
    rows = [(f.address.table, f.address.column, f.is_primary_key, f.is_unique, f.is_foreign_key, ",".join(f.finite_domain)) for f in db.features()]
    found = spark.createDataFrame(rows, "table_name string, column_name string, is_primary_key boolean, is_unique boolean, is_foreign_key boolean, listed string")
    counts = [df.agg(F.lit(t).alias("table_name"), F.count("*").alias("rows")) for t, df in sorted(db.tables.items())]
    return found.join(counts[0].unionAll(counts[1]).unionAll(counts[2]), "table_name")


@query(ORACLE_SQL["document_rewrite"])
def stream_documents(spark, sf_dir):
    """Documents as a stream of four batches; the second is written, but fails before that is noted, and comes again."""
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit('{"k":'), F.get_json_object("props", "$.k"), F.lit(',"who":{"mail":"u'), F.col("event_id"), F.lit('@Example.ORG"},"tags":["tag'), F.col("event_id") % 5, F.lit('"," "]}')).alias("doc"))
    mails = e.select(F.lit("email").alias("type"), F.concat(F.lit("u"), F.col("event_id"), F.lit("@example.org")).alias("key"), F.concat(F.lit("x"), F.col("event_id")).alias("replacement"))
    tags = spark.range(5).select(F.lit("free_text").alias("type"), F.concat(F.lit("tag"), F.col("id")).alias("key"), F.concat(F.lit("t"), F.col("id")).alias("replacement"))
    folder, words, seen = f"{work_dir(spark)}/stream-{uuid.uuid4().hex}", stage_table(mails.unionByName(tags), "words"), []
    e.repartition(4, "event_id").write.option("parquet.block.size", 4 << 20).parquet(f"{folder}/in")  # files that can be split

    def rewrite(batch: DataFrame) -> DataFrame:
        seen.append(batch)
        out = rewrite_documents(batch, "doc", words, {"who.mail": "email"}, {"email": "EmailAddress"})
        if len(seen) == 2:
            out.write.mode("overwrite").parquet(f"{folder}/out/batch=1")
            raise InterruptedError("stopped on the way")
        return out

    def go():
        stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        return start_batches(stream, rewrite, f"{folder}/out", f"{folder}/checkpoint")

    stopped = go()
    try:
        stopped.awaitTermination()
    except Exception as error:
        if "stopped on the way" not in str(error):
            raise
    go().awaitTermination()
    return written_batches(spark, f"{folder}/out", e.schema)
