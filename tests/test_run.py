"""Whole runs, checks, control data and streams."""

from datetime import UTC, datetime, timedelta

import pytest
from demo import APPROVALS, SENSITIVE, database
from pyspark.sql import functions as F

import __spark_entry__ as entry
from palimpsest.control import ControlStore, Refused
from palimpsest.functions.prf import Secret
from palimpsest.lifecycle import NeedsApproval, analyse, execute, load_approvals, publish
from palimpsest.operators import checks as C
from palimpsest.operators.profile import aggregates, samples
from palimpsest.operators.rewrite import build_dictionary
from palimpsest.plans.model import Address, PolicyColumn
from palimpsest.plans.rulepack import default_pack
from palimpsest.sources.catalog import Resource
from palimpsest.streaming.rewrite import rewrite_stream, start

KEY = b"0123456789abcdef0123456789abcdef"
PACK = default_pack()


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    db = database(spark)
    policy = analyse(db, PACK, approvals=load_approvals(__import__("json").dumps(APPROVALS)))
    return db, policy, execute(db, policy, PACK, Secret(KEY), Resource("sink", "parquet", str(tmp_path_factory.mktemp("sink"))), "run-1", "me")


def test_classification(spark):
    found = analyse(database(spark), PACK)
    got = {f"{c.address.table}.{c.address.column}": c.semantic_type for c in found.columns if c.sensitive}
    assert got == SENSITIVE
    waiting = {c.address.column for c in found.columns if c.needs_approval}
    assert waiting == {"city", "address", "profile"}
    with pytest.raises(NeedsApproval):
        execute(database(spark), found, PACK, Secret(KEY), Resource("x", "parquet", "/nowhere"))
    # without a detector, texts have not been looked at
    unmeasured = analyse(database(spark), PACK, detector=None)
    assert next(c for c in unmeasured.columns if c.address.column == "comment").needs_approval


def test_run(run, tmp_path):
    db, policy, done = run
    assert [c for c in done.passport.checks if not c.passed] == []
    assert {c.requirement for c in done.passport.checks} == {"F-4", "F-4a", "F-5", "F-7", "F-8", "F-9", "F-10", "F-11", "R-3"}
    before = {r["id"]: r for r in db.tables["clients"].collect()}
    after = {r["id"]: r for r in done.result.tables["clients"].collect()}
    assert db.tables["clients"].schema.simpleString() == done.result.tables["clients"].schema.simpleString()
    for i, a in before.items():
        b = after[i]
        for name in ("email", "full_name", "phone", "inn", "snils", "client_code", "birth_date", "city", "address", "profile"):
            assert a[name] != b[name], name
        assert a["segment"] == b["segment"] and (a["marital_status"] is None) == (b["marital_status"] is None)
        assert b["profile"].endswith(f'"loyalty_points":{i}.50}}')
    emails = {r["client_email"] for r in done.result.tables["orders"].collect()}
    assert emails <= {r["email"] for r in after.values()}
    target = publish(done, str(tmp_path))
    assert KEY.decode() not in open(f"{target}/passport.json").read()


def test_run_by_cells(spark, run, tmp_path, monkeypatch):
    """A large dictionary is laid down by key; the result is the same."""
    from palimpsest import lifecycle

    db, policy, done = run
    monkeypatch.setattr(lifecycle, "LARGE", 0)
    again = execute(db, policy, PACK, Secret(KEY), Resource("sink", "parquet", str(tmp_path)), "run-1", "me")
    assert [c for c in again.passport.checks if not c.passed] == [] and again.passport.counts == done.passport.counts
    for name, df in done.result.tables.items():
        assert sorted(map(str, df.collect())) == sorted(map(str, again.result.tables[name].collect())), name


def test_runs_repeat(run):
    db, policy, done = run

    def words(key):
        return sorted(map(tuple, build_dictionary(done.plan, db.table, PACK, Secret(key)).collect()))

    assert words(KEY) == words(KEY) != words(KEY[::-1])


def test_checks_find_faults(run):
    db, policy, done = run
    a, b = db.tables["clients"], done.result.tables["clients"]
    name = next(c for c in policy.columns if c.address.column == "full_name")
    leak = b.withColumn("full_name", F.when(F.col("id") == 3, F.lit(a.where("id = 3").first()["full_name"] + " ")).otherwise(F.col("full_name")))
    assert not C.check_completeness(a, leak, ["id"], name).passed
    assert not C.check_completeness(a, a, None, name).passed
    assert not C.check_volume(a, b.where("id > 0")).passed
    assert not C.check_schema(a, b.drop("city")).passed
    assert not C.check_consistency([(a, b.withColumn("full_name", F.concat("full_name", F.col("id"))), ["id"], name)], "full_name").passed
    assert not C.check_diversity(a, b.withColumn("full_name", F.lit("one")), [name])[0].passed
    assert not C.check_foreign_key(done.result.tables["orders"], "client_email", a, "email", "x").passed
    email = next(c for c in policy.columns if c.address.qualified == "public.clients.email")
    assert not C.check_plausibility(b.withColumn("email", F.lit("none")), email).passed
    doubled = a.unionByName(a.withColumn("email", F.upper("email")))
    assert not C.check_spellings(doubled, email).passed


def test_containment_paths_agree(spark):
    texts = spark.createDataFrame([("abcdefgh",), ("xxabcdefyy",), ("nothing",), (None,), ("abcdef",)], "t string")
    sought = spark.createDataFrame([("abcdef",), ("abc",), ("cdefgh",)], "needle string")
    assert C.containing(texts, "t", sought) == C.containing(texts, "t", sought, most=0) == 3
    assert C.containing(texts, "t", sought.where("false")) == 0


def test_profile_edges(spark):
    empty = spark.createDataFrame([], "a int, b string")
    assert [tuple(r)[1:] for r in aggregates(empty).collect()] == [(0, 0, 0, 0.0, 0.0)] * 2
    df = spark.createDataFrame([(1, "x"), (None, "yy"), (1, None), (None, "yy")], "a int, value string")
    got = {r["column"]: tuple(r)[1:] for r in aggregates(df).collect()}
    assert got == {"a": (4, 2, 1, 1.0, 0.5), "value": (4, 3, 2, 5 / 3, 0.25)}
    assert {k: sorted(v) for k, v in samples(df, ["a", "value"]).items()} == {"a": ["1"], "value": ["x", "yy"]}


def test_stream_equals_batch(spark, tmp_path):
    from palimpsest.operators.rewrite import rewrite_table

    rows = spark.createDataFrame([(1, "Ann", "some words"), (2, "Bob", None), (3, None, "  "), (4, "Ann", "more")], "id int, name string, note string")
    rows.write.parquet(str(tmp_path / "in"))
    words = spark.createDataFrame([("Ann", "Zoe")], "key string, replacement string")
    columns = [PolicyColumn(Address("s", "t", "name"), "string", True, "full_name", "Typed", "Function"), PolicyColumn(Address("s", "t", "note"), "string", True, "free_text", "TextWipe", "Function")]
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = start(rewrite_stream(stream, columns, words, PACK, Secret(KEY)), str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("id").collect()
    assert got == rewrite_table(rows, columns, words, PACK, Secret(KEY)).orderBy("id").collect()
    assert got[0]["name"] == "Zoe" and got[1]["name"] != "Bob" and got[2]["note"] == "  " and got[1]["note"] is None


def test_control(spark, tmp_path):
    now = [datetime(2024, 1, 1, tzinfo=UTC)]
    store = ControlStore(spark, str(tmp_path), lambda: now[0])
    for who, role in (("own", "owner"), ("op", "operator"), ("con", "consumer")):
        store.add_identity(who, role)
    with pytest.raises(Refused):
        store.register("con", "sources", "s", "Source", "parquet")
    with pytest.raises(ValueError, match="id"):
        store.register("op", "sources", "bad id", "x", "parquet")
    with pytest.raises(ValueError, match="connection"):
        store.register("op", "sources", "s", "Host=x;Password=y", "parquet")
    store.register("op", "sources", "s", "Source", "parquet")
    store.register("op", "sinks", "k", "Sink", "parquet")
    with pytest.raises(ValueError, match="ready"):
        store.request("op", "s", "k", "test")
    store.announce("sources", ["s"])
    store.announce("sinks", ["k"])
    assert store.request("op", "s", "k", "test") == 1
    now[0] += timedelta(minutes=3)
    with pytest.raises(ValueError, match="ready"):
        store.request("op", "s", "k", "test")
    assert store.take("run-1")["id"] == 1 and store.take("run-2") is None
    with pytest.raises(Refused):
        store.grant("own", 1, "con")
    store.finish(1, "{}", True)
    with pytest.raises(Refused):
        store.download("con", 1, "/pub")
    store.grant("own", 1, "con")
    assert store.download("con", 1, "/pub") == "/pub/run-1" and store.passport(1) == "{}"
    store.revoke("own", 1, "con")
    with pytest.raises(Refused):
        store.download("con", 1, "/pub")
    store.grant("own", 1, "con")
    assert store.download("con", 1, "/pub") == "/pub/run-1"
    store.disable("op", "sources", "s")
    with pytest.raises(ValueError, match="offer"):
        store.request("op", "s", "k", "x")
    assert store.table("audit").where("action = 'download refused'").count() == 2


def test_entry(spark):
    assert entry.entry(spark).where("passed").count() == 8
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_profile_counts_exactly_at_every_size(spark, monkeypatch):
    from palimpsest import lifecycle, queries
    from palimpsest.operators import profile

    monkeypatch.setattr(profile, "EXACT_ROWS", 100, raising=False)  # where estimates used to begin
    folder = "/root/testdata/sf0.01"
    for name, of, column in (("column_aggregate", "customer", "c_name"), ("column_aggregate_lineitem", "lineitem", "l_orderkey")):
        got = {r["column"]: r["distinct_values"] for r in queries.QUERIES[name](spark, folder).collect()}
        assert got[column] == queries.table(spark, folder, of).select(column).distinct().count()
    db = lifecycle.Database({"customer": queries.table(spark, folder, "customer")}, {})
    found = {f.address.column: f.distinct for f in lifecycle.profile(db, None)}
    assert found["c_name"] == db.tables["customer"].select("c_name").distinct().count()


def test_stream_of_batches(spark, run, tmp_path):
    """Documents and exceptions by stream, stopped once and restarted, are those of the batch rewrite."""
    from palimpsest.operators.rewrite import rewrite_table
    from palimpsest.streaming.rewrite import start_batches, written_batches

    db, policy, done = run
    rows = db.tables["clients"]
    columns = done.plan.tables["public.clients"]
    words = build_dictionary(done.plan, db.table, PACK, Secret(KEY))
    marks = [Secret(KEY).fingerprint(rows.first()["full_name"])]
    rows.repartition(3, "id").write.parquet(str(tmp_path / "in"))
    n = []

    def rewrite(batch):
        n.append(1)
        if len(n) == 3:
            raise InterruptedError("stopped on the way")
        return rewrite_table(batch, columns, words, PACK, Secret(KEY), marks)

    def go():
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        return start_batches(stream, rewrite, str(tmp_path / "out"), str(tmp_path / "checkpoint"))

    with pytest.raises(Exception, match="stopped on the way"):
        go().awaitTermination()
    go().awaitTermination()
    go().awaitTermination()  # nothing is left
    got = written_batches(spark, str(tmp_path / "out"), rows.schema)
    assert sorted(map(str, got.collect())) == sorted(map(str, rewrite_table(rows, columns, words, PACK, Secret(KEY), marks).collect()))


def test_publishing(spark, run, tmp_path, monkeypatch):
    """What has no whole manifest is not published; of two that publish at once the first one wins."""
    from palimpsest import lifecycle

    db, policy, done = run
    area = str(tmp_path)
    with monkeypatch.context() as m:
        m.setattr(lifecycle, "plan_files", lambda plan: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            publish(done, area)
    assert lifecycle.published(spark, area, "run-1") is None
    (tmp_path / "run-1.json").write_text('{"run_id": "ru')
    assert lifecycle.published(spark, area, "run-1") is None
    (tmp_path / "run-1.json").unlink()

    late, begun = [], []

    def at_once(plan):
        if not begun:
            begun.append(1)
            late.append(publish(done, area))
        return {}

    with monkeypatch.context() as m:
        m.setattr(lifecycle, "plan_files", at_once)
        with pytest.raises(FileExistsError):
            publish(done, area)
    assert lifecycle.published(spark, area, "run-1") == late[0]
    assert len(list(tmp_path.glob("run-1.*"))) == 3  # the manifest, its folder, and what the first attempt left
    assert spark.read.parquet(f"{late[0]}/clients").count() == db.tables["clients"].count()
