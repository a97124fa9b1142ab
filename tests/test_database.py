"""A live database over JDBC (the one that comes with Spark): descriptions, keys, checks, reads side by side."""

import uuid

import pytest
from pyspark.sql import functions as F

from palimpsest.sources import database
from palimpsest.sources.introspect import domain_literals, schema_fingerprint

DRIVER = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
MADE = [
    'CREATE TABLE "rooms" ("house" INT NOT NULL, "no" INT NOT NULL, "kind" VARCHAR(9) CHECK ("kind" IN (\'a\', \'it\'\'s\')), "size" INT CHECK ("size" > 3), PRIMARY KEY ("no", "house"))',
    'CREATE TABLE "guests" ("id" BIGINT NOT NULL PRIMARY KEY, "mail" VARCHAR(30) NOT NULL, "nick" VARCHAR(30) NOT NULL, "house" INT, "room" INT, "friend" BIGINT REFERENCES "guests" ("id"), "low" INT, "high" INT, UNIQUE ("mail", "nick"), FOREIGN KEY ("room", "house") REFERENCES "rooms" ("no", "house"), CHECK ("low" < "high"))',
    'CREATE UNIQUE INDEX "mails" ON "guests" ("mail")',
    'CREATE TABLE "empty" ("id" BIGINT NOT NULL PRIMARY KEY)',
    'CREATE TABLE "bare" ("x" DOUBLE)',
]


@pytest.fixture(scope="module")
def url(spark):
    at = f"jdbc:derby:memory:t{uuid.uuid4().hex};create=true"
    with database.Connection(spark, at, DRIVER) as db:
        db.execute(*MADE)
        db.execute(*[f"INSERT INTO \"rooms\" VALUES ({k % 3}, {k}, 'a', 9)" for k in range(9)])
        db.execute(*[f"INSERT INTO \"guests\" (\"id\", \"mail\", \"nick\", \"low\", \"high\") VALUES ({k * 1000 - 5000}, 'm{k}', 'n', 1, 2)" for k in range(40)])
        db.execute('INSERT INTO "bare" VALUES (1.5)')
    return at


def test_constraints(spark, url):
    found = database.constraints(database.descriptions(spark, url, DRIVER, "APP"))
    rooms, guests = found["rooms"], found["guests"]
    assert rooms.primary_key == ["no", "house"] and guests.primary_key == ["id"] and set(rooms.checks) == {"kind", "size"}
    assert sorted(guests.unique) == [["mail"], ["mail", "nick"]] and guests.foreign_keys == {"friend": "guests.id"} and guests.checks == {}
    db = database.load(spark, url, DRIVER, "APP")
    assert sorted(db.tables) == ["bare", "empty", "guests", "rooms"]
    features = {f.address.column: f for f in db.features() if f.address.table == "rooms"}
    assert features["kind"].finite_domain == ["a", "it's"] and features["size"].finite_domain == [] and features["no"].is_primary_key
    assert schema_fingerprint(db.features()) == schema_fingerprint(database.load(spark, url, DRIVER, "APP").features())
    with pytest.raises(ValueError, match="no schema name"):
        database.descriptions(spark, url, DRIVER, "x; DROP")


def test_reads_side_by_side(spark, url):
    db = database.load(spark, url, DRIVER, "APP", parts=5)
    guests = db.tables["guests"]
    assert guests.rdd.getNumPartitions() == 5 and sorted(r["id"] for r in guests.collect()) == [k * 1000 - 5000 for k in range(40)]
    sizes = guests.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 5 and max(r["count"] for r in sizes) <= 9
    some = guests.where("mail = 'm7'").select("id")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(mail,m7)" in plan and "ReadSchema: struct<id:bigint>" in plan and [r["id"] for r in some.collect()] == [2000]
    assert db.tables["empty"].count() == 0 and db.tables["rooms"].count() == 9 and db.tables["bare"].first()["x"] == 1.5
    with pytest.raises(ValueError, match="no whole number"):
        database.read_parts(spark, url, '"APP"."bare"', DRIVER, "x")


def test_lists_of_checks(spark):
    checks = ["\"k\" IN ('a', 'b')", "(kind in ('x''y'))", "k > 'a'", "k IN ('a') OR k = 'b'", "((k = ANY (ARRAY['p'::text, 'q'::text])))"]
    df = spark.createDataFrame([(c,) for c in checks], "c string").select(domain_literals(F.col("c")).alias("v"))
    assert [r["v"] for r in df.collect()] == [["a", "b"], ["x'y"], [], [], ["p", "q"]]
