"""Values, keys, renderers, permutations and policies, against known vectors and scalar versions."""

import hashlib
import hmac
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import prf
from palimpsest.functions.canonical import canonical
from palimpsest.functions.index_stream import IndexStream
from palimpsest.functions.prf import Secret
from palimpsest.functions.validators import VALIDATORS, checksum, valid
from palimpsest.operators.derange import NoDerangement, constrained_derangement, derangement
from palimpsest.operators.dictionary import PoolTooSmall, bijection, merged, permutation
from palimpsest.operators.document import dump, leaves, load, rewrite_documents
from palimpsest.operators.generators import Renderers, codes
from palimpsest.plans.classify import inn_ok, snils_ok
from palimpsest.plans.model import Address, Approval, Policy, PolicyColumn, TypeRegistry
from palimpsest.plans.planner import build_plan
from palimpsest.plans.rulepack import Rule, RulePack, Template, default_pack
from palimpsest.sources.catalog import Catalog, Resource, jdbc_url, latest, libpq, read, write

KEY = b"0123456789abcdef0123456789abcdef"
PACK = default_pack()


def forms(spark, kind, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.select("i", canonical(F.col("v"), kind).alias("c")).orderBy("i").select("c").collect()]


@pytest.mark.parametrize(
    ("kind", "raw", "want"),
    [
        ("Text", "a  ", "a"), ("Text", "  a", "  a"), ("Text", "a\t", "a\t"), ("Text", "   ", None), ("Text", None, None), ("Text", "", None),
        ("EmailAddress", "Ivan@Example.RU ", "ivan@example.ru"),
        ("Integer", "0042", "42"), ("Integer", "-0", "0"), ("Integer", " +7 ", "7"), ("Integer", "9" * 40, "9" * 40),
        ("Decimal", "1.500", "1.5"), ("Decimal", "0.10", "0.1"), ("Decimal", "2.0", "2"), ("Decimal", "1.5e3", "1500"), ("Decimal", "-1e-3", "-0.001"), ("Decimal", ".5", "0.5"), ("Decimal", "-0.00", "0"), ("Decimal", "120", "120"), ("Decimal", "00.10E1", "1"),
        ("Boolean", " YES", "true"), ("Boolean", "f", "false"), ("Boolean", "", None),
        ("Timestamp", "2026-08-18T15:00:00+03:00", "2026-08-18T12:00:00.0000000Z"), ("Timestamp", "2026-08-18T12:00:00Z", "2026-08-18T12:00:00.0000000Z"), ("Timestamp", "2026-08-18 12:00:00.1234567", "2026-08-18T12:00:00.1234567Z"), ("Timestamp", "2026-08-18", "2026-08-18T00:00:00.0000000Z"), ("Timestamp", "1969-12-31T23:59:59Z", "1969-12-31T23:59:59.0000000Z"),
        ("Binary", "\\xDEADBEEF", "deadbeef"), ("Binary", "0xAB", "ab"), ("Binary", "\\x", None),
    ],
)
def test_canonical(spark, kind, raw, want):
    assert forms(spark, kind, [raw]) == [want]


@pytest.mark.parametrize(("kind", "raw"), [("Integer", "4a"), ("Integer", "1.5"), ("Decimal", "1.2.3"), ("Decimal", "."), ("Decimal", "1e"), ("Boolean", "maybe"), ("Timestamp", "yesterday"), ("Binary", "abc"), ("Binary", "zz")])
def test_canonical_refuses(spark, kind, raw):
    with pytest.raises(Exception, match="not a valid"):
        forms(spark, kind, [raw])


def test_unknown_kind():
    with pytest.raises(ValueError, match="unknown"):
        canonical(None, "Colour")


def test_timestamps_do_not_depend_on_the_session(spark):
    held = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert forms(spark, "Timestamp", ["2024-03-10 02:30:00"]) == ["2024-03-10T02:30:00.0000000Z"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", held)


def test_prf(spark):
    s = prf.Secret(KEY)
    assert s.index("Иванов") == 14043331200226716518
    df = spark.createDataFrame([("Иванов", ""), ("A|last_name", ""), ("A", "last_name"), ("", "x" * 300)], "v string, l string")
    for r in s.keyed(df).select("v", "l", prf.index_hex(F.col("v"), F.col("l")).alias("i"), prf.fingerprint(F.col("v")).alias("f"), prf.index_decimal(prf.index_hex(F.col("v"), F.col("l"))).alias("d")).collect():
        assert int(r["i"], 16) == s.index(r["v"], r["l"]) == int(r["d"])
        assert r["f"] == hmac.new(KEY, r["v"].encode(), hashlib.sha256).hexdigest() == s.fingerprint(r["v"])
    plan = s.keyed(df).select(prf.fingerprint(F.col("v")))._jdf.queryExecution().toString()
    assert bytes(b ^ 0x36 for b in KEY).hex() not in plan.lower()
    assert prf.encode_key("A|last_name") != prf.encode_key("A", "last_name")
    long = prf.Secret(KEY * 3)
    assert int(long.keyed(df).where("v = 'Иванов'").select(prf.index_hex(F.col("v"))).first()[0], 16) == long.index("Иванов")


def test_secret_guards():
    with pytest.raises(ValueError, match="32"):
        prf.Secret(b"short")
    s = prf.Secret(KEY)
    s.close()
    with pytest.raises(RuntimeError):
        s.index("a")


def scalar_draws(state, bounds):
    m, out = (1 << 64) - 1, []
    for bound in bounds:
        while True:
            state = (state + 0x9E3779B97F4A7C15) & m
            z = state
            z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & m
            z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & m
            z ^= z >> 31
            if z < m - m % bound:
                break
        out.append(z % bound)
    return out


def test_index_stream():
    random.seed(1)
    states = [random.getrandbits(64) for _ in range(200)] + [0, (1 << 64) - 1]
    bounds = [1, 2, 10, 97, (1 << 63) + 1, 12345678901]  # the fifth one rejects half of all values
    stream = IndexStream(states)
    got = [stream.draw(b).astype(np.uint64) for b in bounds]
    for i, s in enumerate(states):
        assert [int(g[i]) for g in got] == scalar_draws(s, bounds)
    with pytest.raises(ValueError, match="range"):
        stream.draw(0)


def test_renderers(spark):
    r = Renderers(PACK)
    at = np.arange(1000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for t in ("inn_person", "inn_legal", "snils", "phone", "passport", "birth_date", "full_name", "email", "city", "postal_address", "free_text"):
        values = r.render(t, at)
        assert list(values) == list(r.render(t, at))
        assert list(r.render(t, at[500:])) == list(values[500:])
        df = spark.createDataFrame([(v,) for v in values], "v string")
        assert df.where(~valid(F.col("v"), t)).count() == 0
    assert len(set(r.render("inn_person", at))) > 990
    assert all(inn_ok(v) for v in r.render("inn_person", at)) and all(snils_ok(v) for v in r.render("snils", at))
    broken = [v[:-1] + str((int(v[-1]) + 1) % 10) for v in r.render("inn_legal", at)]
    assert not any(inn_ok(v) for v in broken)
    d = scalar_draws(5, [len(PACK.components["phone_operator"])] + [10] * 7)
    assert r.render("phone", np.array([5], np.uint64))[0] == "+7" + PACK.components["phone_operator"][d[0]] + "".join(map(str, d[1:]))
    with pytest.raises(ValueError, match="generator"):
        r.render("nothing", at)
    for bad in ([], ["1"], ["ab"]):
        with pytest.raises(ValueError, match="code|empty"):
            codes(bad, 2, "x")


def test_rule_packs():
    assert Template("{a} {b}").components == ["a", "b"]
    for bad in ("plain", "{a", "a}", "{a{b}}", "{}"):
        with pytest.raises(ValueError, match="template|brace"):
            Template(bad)
    parts = {"a": ["1", "2", "3", "4"], "b": ["x", "y", "z"], "c": ["p", "q"]}
    rules = [Rule("t", 1)]
    assert RulePack("v", rules, parts, {"t": ["{a}{b}{c}"]}).cardinality("t") == 24
    assert RulePack("v", rules, {"a": [str(i) for i in range(1000)]}, {"t": ["{a}" * 10]}).cardinality("t") == (1 << 64) - 1
    for args in ((rules, {"a": []}, {}), (rules, {"a": ["1", "1"]}, {}), (rules, parts, {"t": []}), (rules, parts, {"t": ["{d}"]}), ([], parts, {}), ([Rule("t", 1), Rule("u", 1)], parts, {})):
        with pytest.raises(ValueError):
            RulePack("v", *args)
    pack = RulePack.from_json('{"version": "1", "rules": [{"semanticType": " T ", "rank": 3}], "components": {"a": ["x"]}, "templates": {"T": ["{a}"]}}')
    assert pack.rules[0].semantic_type == "t" and "t" in pack.templates


def test_registry():
    r = TypeRegistry({"city": 28, "email": 12})
    assert r.most_specific(["city", "Email "]) == "email"
    assert r.most_specific(["zebra", "ant"]) == "ant"
    assert r.most_specific([]) == "unknown"
    with pytest.raises(ValueError):
        TypeRegistry({"a": 1, "b": 1})


def test_checksums(spark):
    assert checksum("") is None
    with pytest.raises(ValueError):
        checksum("luhn")
    assert VALIDATORS and valid(F.lit("x"), "nothing") is None
    rows = spark.createDataFrame([("+79001234567", True), ("+89001234567", False), ("9001234567", False)], "v string, want boolean")
    assert rows.where(valid(F.col("v"), "phone") != F.col("want")).count() == 0


def test_derangements():
    for n in range(3, 40):
        values = [f"v{i}" for i in range(n)]
        made = derangement(values, n)
        assert sorted(made.values()) == sorted(values) and all(k != v for k, v in made.items())
        assert made == derangement(values, n)
    for values, reason in ((["a"], "SingleValue"), ([], "SingleValue"), (["a", "b"], "TwoValuesOnlySwap"), (["a", "a", "b"], "DuplicateValues")):
        with pytest.raises(NoDerangement) as e:
            derangement(values, 1)
        assert e.value.reason == reason
    allowed = {"a": ["b"], "b": ["c"], "c": ["a"]}
    with pytest.raises(NoDerangement, match="MatchingIsUnique"):
        constrained_derangement(list("abc"), allowed, 1)
    with pytest.raises(NoDerangement, match="NoPerfectMatching"):
        constrained_derangement(list("abc"), {"a": ["b"], "b": ["b", "c"], "c": ["b"]}, 1)
    seen = set()
    for seed in range(20):
        made = constrained_derangement(list("abcde"), {"a": ["b", "c"]}, seed)
        assert made["a"] in "bc" and all(k != v for k, v in made.items()) and sorted(made.values()) == list("abcde")
        seen.add(tuple(made.items()))
    assert len(seen) > 1


def small_pack(n):
    return RulePack("v", [Rule("thing", 1)], {"a": [f"t{i}" for i in range(n)]}, {"thing": ["{a}"]})


def sequential(keys, pack, secret):
    r, used, out = Renderers(pack), set(), {}
    for key in sorted(keys):
        index = secret.index(key)
        for probe in range(64):
            c = r.render("thing", np.array([(index + probe) % (1 << 64)], np.uint64))[0]
            if c != key and c not in used:
                break
        else:
            raise PoolTooSmall
        used.add(c)
        out[key] = c
    return out


def test_bijection_rounds_equal_one_by_one(spark):
    secret = prf.Secret(KEY)
    for n, pool in ((40, 60), (1, 2), (0, 3)):
        keys = [f"t{i}" for i in range(n)]
        df = spark.createDataFrame([(k,) for k in keys], "key string")
        want = sequential(keys, small_pack(pool), secret)
        for small in (0, 1000):
            assert {r["key"]: r["replacement"] for r in bijection(df, "thing", small_pack(pool), secret, small).collect()} == want
    df = spark.createDataFrame([(f"t{i}",) for i in range(9)], "key string")
    for small in (0, 1000):
        with pytest.raises(PoolTooSmall):
            bijection(df, "thing", small_pack(5), secret, small)
    with pytest.raises(ValueError, match="generator"):
        bijection(df, "other", small_pack(5), secret)


def test_bijection_of_more_values_than_the_templates_have(spark):
    secret, rules = prf.Secret(KEY), [Rule("thing", 1)]
    parts = {"a": [f"t{i}" for i in range(5)], "b": [f"u{i}" for i in range(60)]}
    pack = RulePack("v", rules, parts, {"thing": ["{a}"]}, reserve={"thing": ["{b}"]})
    keys = [f"t{i}" for i in range(40)]
    for n in (3, 40):  # 3: the type's own templates, as without a reserve
        df = spark.createDataFrame([(k,) for k in keys[:n]], "key string")
        want = sequential(keys[:n], small_pack(5) if n == 3 else pack.wider("thing"), secret)
        for small in (0, 1000):
            assert {r["key"]: r["replacement"] for r in bijection(df, "thing", pack, secret, small).collect()} == want
    assert pack.fingerprint != RulePack("v", rules, parts, {"thing": ["{a}"]}).fingerprint
    assert pack.wider("other") is None and pack.wider("thing").wider("thing") is None
    with pytest.raises(PoolTooSmall):
        bijection(spark.range(70).selectExpr("concat('k', id) AS key"), "thing", pack, secret)
    # more names than the 30,000 of the default pack
    made = bijection(spark.range(40_000).selectExpr("concat('Customer', id) AS key"), "full_name", default_pack(), secret)
    n, different, named = made.selectExpr("count(*)", "count(DISTINCT replacement)", "count_if(replacement rlike '^[а-яёА-ЯЁ]+ [а-яёА-ЯЁ]+ [а-яёА-ЯЁ]+$')").first()
    assert n == different == named == 40_000


def test_merge_and_permutation(spark):
    one = spark.createDataFrame([("a", "b")], "key string, replacement string")
    with pytest.raises(ValueError, match="two dictionaries"):
        merged([one, one])
    with pytest.raises(ValueError, match="not among"):
        permutation(spark.createDataFrame([("z",)], "key string"), "t", ("a", "b", "c"), prf.Secret(KEY))


def test_documents(spark):
    text = '{"a":{"b":["x",1.50,null,true,{"c":"y"}]},"d":" ","e":1e5}'
    assert list(leaves(load(text))) == [("a.b", "x"), ("a.b.c", "y")]
    assert dump(load(text)) == text
    assert list(leaves(load('"root"'))) == [("", "root")]
    df = spark.createDataFrame([(1, text, "k"), (2, "[1,2]", "k"), (3, None, "k"), (4, '"x"', "k"), (5, "", "k")], "id int, doc string, key string")
    words = spark.createDataFrame([("free_text", "x", "X"), ("email", "y", "Ы")], "type string, key string, replacement string")
    got = {r["id"]: (r["doc"], r["key"]) for r in rewrite_documents(df, "doc", words, {"a.b.c": "email"}).collect()}
    assert got == {1: ('{"a":{"b":["X",1.50,null,true,{"c":"Ы"}]},"d":" ","e":1e5}', "k"), 2: ("[1,2]", "k"), 3: (None, "k"), 4: ('"X"', "k"), 5: ("", "k")}
    with pytest.raises(Exception, match="no replacement"):
        rewrite_documents(df, "doc", words.where("key = 'x'"), {"a.b.c": "email"}).collect()


def test_policies():
    def column(name, **more):
        return PolicyColumn(Address("s", "t", name), "varchar", **more)

    good = Policy("f", "g", [column("a", sensitive=True, semantic_type="email", strategy="Dictionary"), column("b")])
    assert good.problems() == [] and Policy.from_json(good.to_json()) == good
    bad = Policy("", "", [column("a", sensitive=True), column("a", strategy="Function"), column("c", needs_approval=True, canonical_kind="Odd")])
    assert len(bad.problems()) == 8
    with pytest.raises(ValueError, match="can't be run"):
        build_plan(bad)
    accepted = good.approved([Approval("s.t.b", True, "free_text", "TextWipe", None, "because")])
    assert accepted.columns[1].strategy == "Function" and accepted.columns[1].source == "Human"
    refused = good.approved([Approval("s.t.a", False)])
    assert (refused.columns[0].strategy, refused.columns[0].semantic_type) == ("None", "unknown")
    with pytest.raises(ValueError, match="unknown columns"):
        good.approved([Approval("s.t.zz", True)])
    one = Policy("f", "g", [column("a", sensitive=True, semantic_type="m", strategy="Derangement"), column("b", sensitive=True, semantic_type="m", strategy="Derangement")])
    plan = build_plan(one, {Address("s", "t", "a"): ["x", "y", "z", "w"], Address("s", "t", "b"): ["x", "y", "z"]})
    assert plan.domains[0].allowed == ("x", "y", "z")
    with pytest.raises(ValueError, match="allows"):
        build_plan(one)


def test_catalog(spark, tmp_path):
    text = '{"sources": [{"id": "a", "kind": "parquet", "path": "${HERE}/in"}, {"id": "b", "kind": "jdbc", "connection": "${NOPE}"}], "sinks": [{"id": "c", "kind": "csv", "path": "${HERE}/out"}]}'
    found = Catalog.load(text, {"HERE": str(tmp_path)})
    assert list(found.sources) == ["a"] and "NOPE" in found.skipped[0]
    with pytest.raises(KeyError, match="known: a"):
        found.source("b")
    with pytest.raises(ValueError, match="no usable"):
        Catalog.load(text, {})
    with pytest.raises(ValueError, match="path"):
        Resource("x", "dump").check()
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, s string")
    for kind in ("parquet", "orc", "json", "csv"):
        sink = Resource("x", kind, str(tmp_path / kind))
        write(df, sink, "t")
        write(df.where("i = 1"), sink, "t")  # nothing of the first run stays
        assert read(spark, sink, "t", df.schema).collect() == df.where("i = 1").collect()
        dump = Resource("y", "dump", str(tmp_path / kind))
        assert read(spark, dump, "t").count() == 1
    url, properties = jdbc_url("Host=db;Port=5433;Database=d;Username=u;Password='it''s;x'")
    assert url == "jdbc:postgresql://db:5433/d" and properties["password"] == "it's;x"
    assert libpq({"host": "h", "password": "a'b\\"}) == "host='h' password='a\\'b\\\\'"
    assert latest(["1", "10", "9"]) == "9"


def test_decimal_plan_stays_small(spark):
    """Each part of a value is extracted once: the plan holds few regular expressions."""
    df = spark.createDataFrame([("1e3",)], "v string").select(canonical(F.col("v"), "Decimal").alias("c"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") < 10 and len(plan) < 20_000
    stamp = spark.createDataFrame([("x",)], "v string").select(canonical(F.col("v"), "Timestamp").alias("c"))
    assert len(stamp._jdf.queryExecution().optimizedPlan().toString()) < 20_000


def test_rewrite_of_several_columns_reads_each_column_once(spark):
    from palimpsest.operators.rewrite import rewrite_table
    from palimpsest.plans.model import Address, PolicyColumn

    rows = [(i, f"n{i % 5}" if i % 3 else None, f"m{i % 7}", None) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, __own string, b string, c string")
    columns = [PolicyColumn(Address("s", "t", n), "string", True, "full_name", "Typed", "Function") for n in ("b", "c")]
    none = spark.createDataFrame([], "key string, replacement string")
    got = {r["id"]: r for r in rewrite_table(df.withColumnRenamed("__own", "a"), columns, none, default_pack(), Secret(b"k" * 32)).collect()}
    assert len(got) == 60 and all(got[i]["a"] == r[1] and got[i]["c"] is None and got[i]["b"] != r[2] for i, r in enumerate(rows))
    assert len({r["b"] for r in got.values()}) == 7


def test_schema_check_looks_at_nulls(spark):
    from pyspark.sql.types import IntegerType, StructField, StructType

    from palimpsest.operators import checks

    strict = spark.createDataFrame([(1,)], StructType([StructField("a", IntegerType(), False)]))
    loose = spark.createDataFrame([(1,)], "a int")
    assert checks.check_schema(strict, loose).passed and checks.check_schema(loose, strict).passed
    assert not checks.check_schema(strict, spark.createDataFrame([(None,)], "a int")).passed
    assert not checks.check_schema(strict, spark.createDataFrame([(1,)], "a long")).passed


def test_rows_with_a_null_in_the_key_are_checked(spark):
    from palimpsest.operators import checks

    a = spark.createDataFrame([(None, "x"), (1, "y")], "k int, v string")
    assert checks.survivors(a, a, ["k"], "v") == 2


def test_long_lists_are_no_finite_domain(spark):
    from palimpsest.operators import dictionary

    keys = spark.range(20).select(F.col("id").cast("string").alias("key"))
    assert len(dictionary.listed(keys)) == 20
    with pytest.raises(ValueError, match="finite"):
        dictionary.listed(keys, 19)
