"""Queries for plans, sources and sinks, control data and streams, with DuckDB SQL of the same result."""

from __future__ import annotations

import json
import re
import uuid
from datetime import UTC, datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from palimpsest import lifecycle
from palimpsest.control import ControlStore, Refused
from palimpsest.functions.canonical import canonical
from palimpsest.functions.index_stream import GAMMA, IndexStream
from palimpsest.functions.prf import Secret
from palimpsest.functions.validators import checksum, valid
from palimpsest.operators import checks as C
from palimpsest.operators import dictionary, profile
from palimpsest.operators.derange import NoDerangement, constrained_derangement, derangement
from palimpsest.operators.generators import codes, rendered
from palimpsest.operators.rewrite import preflight, resolve, rewrite_table
from palimpsest.plans.classify import classify
from palimpsest.plans.model import Address, Approval, CheckResult, Features, Policy, PolicyColumn, TypeRegistry
from palimpsest.plans.passport import build_passport
from palimpsest.plans.planner import Plan, build_plan, plan_files
from palimpsest.plans.rulepack import RulePack, Template
from palimpsest.plans.storage import stage_table, work_dir
from palimpsest.registry import PACK, query, secret, splitmix, sql_bijection, sql_columns, sql_derangement, sql_index, sql_keys, sql_list, sql_rendered, table, u64
from palimpsest.sources import catalog
from palimpsest.sources.catalog import Catalog, Resource
from palimpsest.sources.introspect import catalog_constraints, describe, estimated_rows, simple_keys
from palimpsest.streaming.rewrite import rewrite_stream, start


def _folder(spark: SparkSession) -> str:
    return f"{work_dir(spark)}/queries-{uuid.uuid4().hex}"


def _rows(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> list:
    """The rows of one of the two smallest tables, nation and region."""
    return table(spark, sf_dir, name).orderBy(columns[0]).select(*columns).collect()


def _frame(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _fails(f, *args) -> bool:
    try:
        f(*args)
    except (ValueError, RuntimeError, KeyError):
        return True
    return False


# ---------------------------------------------------------------- descriptions and constraints


@query(f"""SELECT column_name AS "column", data_type, CASE ordinal WHEN 1 THEN true ELSE false END AS is_primary_key, ordinal <= 2 AS is_unique, ordinal = 3 AS is_foreign_key,
 CASE ordinal WHEN 2 THEN 'the name' ELSE '' END AS comment, CASE ordinal WHEN 2 THEN (SELECT list(n_name ORDER BY n_name) FROM nation) ELSE [] END AS finite_domain FROM ({sql_columns("nation")})""")
def merge_description(spark, sf_dir):
    """Columns of a table merged with its keys, comments and the values that a CHECK lists."""
    nation = table(spark, sf_dir, "nation")
    names = [r["n_name"] for r in _rows(spark, sf_dir, "nation", "n_name")]
    listed = ", ".join("'" + n.replace("'", "''") + "'::text" for n in names)
    keys = _frame(spark, [("nation", "p", ["n_nationkey"], ""), ("nation", "f", ["n_regionkey"], "region.r_regionkey")], "table_name string, kind string, columns array<string>, target string")
    indexes = _frame(spark, [("nation", ["n_name"])], "table_name string, columns array<string>")
    checks = _frame(spark, [("nation", ["n_name"], f"CHECK ((n_name = ANY (ARRAY[{listed}])))"), ("nation", ["n_name", "n_regionkey"], "CHECK (x = ANY ('a'::text))")], "table_name string, columns array<string>, definition string")
    comments = _frame(spark, [("nation", "n_name", "the name"), ("nation", "n_nationkey", "")], "table_name string, column_name string, comment string")
    found = describe(nation, "public", "nation", catalog_constraints(keys, indexes, checks, comments)["nation"])
    rows = [(f.address.column, f.data_type, f.is_primary_key, f.is_unique, f.is_foreign_key, f.comment, f.finite_domain) for f in found]
    return _frame(spark, rows, "column string, data_type string, is_primary_key boolean, is_unique boolean, is_foreign_key boolean, comment string, finite_domain array<string>")


@query("""SELECT t AS table_name, kind, "columns", target FROM (
 SELECT DISTINCT CASE WHEN n_regionkey % 2 = 0 THEN 'even' ELSE 'odd' END || n_regionkey AS t, CASE n_nationkey % 3 WHEN 0 THEN 'p' WHEN 1 THEN 'u' ELSE 'f' END AS kind, n_name AS c, n_nationkey AS k FROM nation),
 LATERAL (SELECT [c] AS "columns", CASE kind WHEN 'f' THEN 'region.' || c ELSE '' END AS target) WHERE kind <> 'p' OR k = (SELECT max(n.n_nationkey) FROM nation n WHERE n.n_nationkey % 3 = 0 AND CASE WHEN n.n_regionkey % 2 = 0 THEN 'even' ELSE 'odd' END || n.n_regionkey = t)""")
def catalog_keys(spark, sf_dir):
    """Primary, unique and foreign keys of many tables from a catalog's rows; keys listed twice count once."""
    n = table(spark, sf_dir, "nation").orderBy("n_nationkey")
    name = F.concat(F.when(F.col("n_regionkey") % 2 == 0, "even").otherwise("odd"), "n_regionkey")
    kind = F.element_at(F.array(F.lit("p"), F.lit("u"), F.lit("f")), F.col("n_nationkey") % 3 + 1)
    keys = n.select(name.alias("table_name"), kind.alias("kind"), F.array("n_name").alias("columns"), F.when(kind == "f", F.concat(F.lit("region."), "n_name")).otherwise("").alias("target"), "n_nationkey")
    last = keys.where("kind = 'p'").groupBy("table_name").agg(F.max_by("columns", "n_nationkey").alias("columns")).withColumn("kind", F.lit("p")).withColumn("target", F.lit(""))
    keys = keys.where("kind <> 'p'").select("table_name", "kind", "columns", "target").unionByName(last)
    none = _frame(spark, [], "table_name string, columns array<string>, definition string")
    found = catalog_constraints(keys.where("kind <> 'u'").unionByName(keys), keys.where("kind = 'u'").select("table_name", "columns"), none, _frame(spark, [], "table_name string, column_name string, comment string"))
    rows = [(t, "p", c.primary_key, "") for t, c in found.items() if c.primary_key]
    rows += [(t, "u", u, "") for t, c in found.items() for u in c.unique] + [(t, "f", [k], v) for t, c in found.items() for k, v in c.foreign_keys.items()]
    return _frame(spark, rows, "table_name string, kind string, columns array<string>, target string")


@query("SELECT 'nation' AS \"table\", count(*) AS rows FROM nation UNION ALL SELECT 'customer', count(*) FROM customer")
def row_estimate(spark, sf_dir):
    """Rows by statistics: those of a table held in memory are exact."""
    out = []
    for name in ("nation", "customer"):
        held = table(spark, sf_dir, name).cache()
        held.count()
        out.append((name, estimated_rows(held)))
        held.unpersist()
    return _frame(spark, out, "table string, rows long")


@query("SELECT 'public.customer' AS \"table\", ['c_custkey'] AS \"key\" UNION ALL SELECT 'public.lineitem', list(column_name ORDER BY ordinal) FROM (" + sql_columns('lineitem') + ") WHERE column_name IN ('l_orderkey', 'l_linenumber') HAVING min(ordinal) = 1")
def primary_keys(spark, sf_dir):
    from palimpsest.sources.introspect import Constraints

    found = describe(table(spark, sf_dir, "customer"), "public", "customer", Constraints(["c_custkey"])) + describe(table(spark, sf_dir, "lineitem"), "public", "lineitem", Constraints(["l_orderkey", "l_linenumber"])) + describe(table(spark, sf_dir, "events"), "public", "events")
    return _frame(spark, sorted(simple_keys(found).items()), "table string, key array<string>")


# ---------------------------------------------------------------- sources and sinks


@query("SELECT kind, sniffed, n, total FROM (VALUES ('parquet', 'parquet'), ('orc', 'orc'), ('json', 'json'), ('csv', 'csv')) t(kind, sniffed), (SELECT count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS total FROM customer)")
def dump_formats(spark, sf_dir):
    """Dumps of four formats, told apart by their content and read back whole."""
    c, folder, out = table(spark, sf_dir, "customer"), _folder(spark), []
    for kind in ("parquet", "orc", "json", "csv"):
        catalog.write(c, Resource("dump", kind, f"{folder}/{kind}"), "customer")
        back = catalog.read(spark, Resource("dump", "dump", f"{folder}/{kind}"), "customer")
        n, total = back.agg(F.count("*"), F.sum(F.col("c_custkey").cast("long"))).first()
        out.append((kind, catalog.sniff(spark, f"{folder}/{kind}/customer"), n, total))
    return _frame(spark, out, "kind string, sniffed string, n long, total long")


@query("SELECT count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS total FROM customer WHERE c_custkey % 3 = 0")
def sink_reset(spark, sf_dir):
    """A sink holds what was written last, and nothing of a former run."""
    c, sink = table(spark, sf_dir, "customer"), Resource("sink", "orc", _folder(spark))
    catalog.write(c, sink, "customer")
    catalog.write(c.where("c_custkey % 3 = 0"), sink, "customer")
    return catalog.read(spark, sink, "customer").agg(F.count("*").alias("n"), F.sum("c_custkey").alias("total"))


_STATUSES = sql_derangement("SELECT DISTINCT rtrim(o_orderstatus, ' ') AS v FROM orders WHERE rtrim(o_orderstatus, ' ') <> ''", "status")


@query(f"SELECT o_orderkey, replacement AS o_orderstatus, o_totalprice FROM orders JOIN ({_STATUSES}) ON key = o_orderstatus")
def dump_with_transform(spark, sf_dir):
    """A table rewritten on its way into a dump, read back from there."""
    o, sink = table(spark, sf_dir, "orders"), Resource("sink", "dump", _folder(spark))
    keys = dictionary.domain_values([(o, "o_orderstatus", "Text")])
    words = dictionary.permutation(keys, "status", dictionary.listed(keys), secret())
    column = PolicyColumn(Address("public", "orders", "o_orderstatus"), "string", True, "status", "Typed", "Derangement")
    catalog.write(rewrite_table(o, [column], words, PACK, secret()), sink, "orders")
    return catalog.read(spark, sink, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("SELECT 'dump-' || max(strftime(o_orderdate, '%Y-%m-%d')) AS latest FROM orders")
def latest_dump(spark, sf_dir):
    names = [r["name"] for r in table(spark, sf_dir, "orders").select(F.concat(F.lit("dump-"), F.date_format("o_orderdate", "yyyy-MM-dd")).alias("name")).distinct().collect()]  # one a day
    return _frame(spark, [(catalog.latest(names),)], "latest string")


@query("SELECT 'sources' AS side, lower(r_name) AS id, 'parquet' AS kind, '/data/' || r_regionkey AS path, false AS skipped FROM region WHERE r_regionkey % 2 = 0 UNION ALL SELECT 'sources', lower(r_name), '', '', true FROM region WHERE r_regionkey % 2 = 1 UNION ALL SELECT 'sinks', 'out', 'csv', '/out', false")
def catalog_entries(spark, sf_dir):
    """A catalog's entries with their variables filled in, and those left out for want of one."""
    rows = _rows(spark, sf_dir, "region", "r_regionkey", "r_name")
    text = json.dumps({"sources": [{"id": r["r_name"].lower(), "kind": "parquet", "path": f"${{{'ROOT' if r['r_regionkey'] % 2 == 0 else 'MISSING'}}}/{r['r_regionkey']}"} for r in rows], "sinks": [{"id": "out", "kind": "csv", "path": "/out"}]})
    found = Catalog.load(text, {"ROOT": "/data"})
    out = [(side, r.id, r.kind, r.path, False) for side, entries in (("sources", found.sources), ("sinks", found.sinks)) for r in entries.values()]
    return _frame(spark, out + [("sources", s.partition(":")[0], "", "", True) for s in found.skipped], "side string, id string, kind string, path string, skipped boolean")


@query("SELECT n_name AS id, CASE n_nationkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true ELSE false END AS accepted FROM nation")
def resource_validation(spark, sf_dir):
    """A dump needs a path, a database a connection, and kinds are known."""
    def made(k: int, name: str) -> Resource:
        return (Resource(name, "dump", "/x"), Resource(name, "dump"), Resource(name, "jdbc", "", "jdbc:postgresql://h/d"), Resource(name, "odd", "/x"))[k % 4]

    return _frame(spark, [(r["n_name"], not _fails(made(r["n_nationkey"], r["n_name"]).check)) for r in _rows(spark, sf_dir, "nation", "n_nationkey", "n_name")], "id string, accepted boolean")


@query("SELECT n_nationkey AS id, 'jdbc:postgresql://host' || n_nationkey || ':' || (5432 + n_nationkey) || '/db' AS url, 'u;' || n_name AS \"user\", 'p\"' AS password FROM nation")
def jdbc_address(spark, sf_dir):
    """Connections in words to JDBC addresses; values in quotes may hold separators and doubled quotes."""
    out = []
    for r in _rows(spark, sf_dir, "nation", "n_nationkey", "n_name"):
        url, more = catalog.jdbc_url(f"Host=host{r['n_nationkey']};Port={5432 + r['n_nationkey']};Database=db;Username=\"u;{r['n_name']}\";Password=\"p\"\"\"")
        out.append((r["n_nationkey"], url, more["user"], more["password"]))
    return _frame(spark, out, "id int, url string, user string, password string")


# ---------------------------------------------------------------- rewriting

_NAMES = sql_bijection(sql_keys("customer", "c_name"), "full_name")


def _words(spark, sf_dir) -> tuple[DataFrame, DataFrame, list[PolicyColumn]]:
    c = table(spark, sf_dir, "customer")
    words = dictionary.bijection(dictionary.domain_values([(c, "c_name", "Text")]), "full_name", PACK, secret())
    return c, words, [PolicyColumn(Address("public", "customer", "c_name"), "string", True, "full_name", "Typed", "Dictionary")]


@query(f"SELECT * FROM ({_NAMES}) UNION ALL SELECT * FROM ({_STATUSES})")
def dictionary_merged(spark, sf_dir):
    """Dictionaries of two domains in one."""
    _, names, _ = _words(spark, sf_dir)
    keys = dictionary.domain_values([(table(spark, sf_dir, "orders"), "o_orderstatus", "Text")])
    return dictionary.merged([names, dictionary.permutation(keys, "status", dictionary.listed(keys), secret())])


@query("SELECT n_regionkey AS id, count(*) > 1 AS refused FROM nation GROUP BY n_regionkey")
def dictionary_duplicate_keys(spark, sf_dir):
    """Dictionaries that share a key are refused."""
    n = table(spark, sf_dir, "nation")
    out = []
    for r in _rows(spark, sf_dir, "region", "r_regionkey"):
        own = n.where(F.col("n_regionkey") == r["r_regionkey"]).select(F.lit("same").alias("key"), F.col("n_name").alias("replacement"))
        out.append((r["r_regionkey"], _fails(dictionary.merged, [own, own.where("false")])))
    return _frame(spark, out, "id int, refused boolean")


@query("SELECT c_name AS \"column\", n AS rows, k AS replaced, n - k AS unchanged FROM (SELECT 'c_name' AS c_name, count(*) AS n, count(CASE WHEN c_custkey % 4 > 0 THEN 1 END) AS k FROM customer)")
def rewrite_counters(spark, sf_dir):
    """Rows, and cells replaced and unchanged, observed while a table is rewritten."""
    c, words, columns = _words(spark, sf_dir)
    seen = Observation(f"counters-{uuid.uuid4().hex}")
    some = c.withColumn("c_name", F.when(F.col("c_custkey") % 4 > 0, F.col("c_name")).otherwise(F.when(F.col("c_custkey") % 8 == 0, "  ")))
    stage_table(rewrite_table(some, columns, words, PACK, secret(), counts=seen), "counted")
    return _frame(spark, [("c_name", seen.get["rows"], seen.get["c_name"], seen.get["rows"] - seen.get["c_name"])], "column string, rows long, replaced long, unchanged long")


@query(f"SELECT c_custkey, 'c_name' AS \"column\", c_name AS before, replacement AS after FROM customer JOIN ({_NAMES}) ON key = c_name ORDER BY c_custkey LIMIT 10")
def diff_on_sample(spark, sf_dir):
    """The first rows before and after a rewrite."""
    c, words, columns = _words(spark, sf_dir)
    return C.diff_sample(c, rewrite_table(c, columns, words, PACK, secret()), ["c_custkey"], ["c_name"])


def _typed(semantic_type: str, where: str) -> str:
    return f"SELECT key, value AS replacement FROM ({sql_rendered(sql_keys(f'(SELECT * FROM customer WHERE {where})', 'c_name'), semantic_type)})"


@query(f"{_typed('city', 'c_custkey % 2 = 1')} UNION ALL {_typed('full_name', 'c_custkey % 2 = 0')}")
def resolve_by_type(spark, sf_dir):
    """Values that a list gives another type are replaced by that type's function."""
    c = table(spark, sf_dir, "customer")
    other = c.where("c_custkey % 2 = 1").select(F.col("c_name").alias("value"), F.lit("city").alias("type"))
    none = _frame(spark, [], "key string, replacement string")
    return resolve(c.select(F.col("c_name").alias("key")), "full_name", none, PACK, secret(), cross_types=other)


@query(f"SELECT key AS id, 'N' || lpad(CAST(CAST(d1 % 1000 AS BIGINT) AS VARCHAR), 3, '0') AS value FROM (SELECT *, {splitmix('s1')} AS d1 FROM (SELECT *, {u64(f'idx + {GAMMA}::UHUGEINT')} AS s1 FROM (SELECT c_custkey AS key, {sql_index('CAST(c_custkey AS VARCHAR)')} AS idx FROM customer)))")
def registered_renderer(spark, sf_dir):
    """A type with a function of its own, registered with the rule pack."""
    from palimpsest.functions import prf

    pack = PACK.with_renderer("badge", lambda s: np.char.add("N", np.char.zfill(s.draw(1000).astype(str), 3)))
    at = secret().keyed(table(spark, sf_dir, "customer").select("c_custkey")).select(F.col("c_custkey").alias("id"), prf.index_hex(F.col("c_custkey").cast("string")).alias("index"))
    return at.select("id", rendered(pack, "badge", F.col("index")).alias("value"))


def _draw(k: int, bound: str) -> str:
    return f"CAST({splitmix(u64(f'c_custkey::UHUGEINT + {k * GAMMA % (1 << 64)}::UHUGEINT'))} % {bound} AS BIGINT)"


@query(f"SELECT c_custkey AS id, {_draw(1, '10')} AS a, {_draw(2, '7')} AS b, {_draw(3, '1000000')} AS c FROM customer")
def bounded_draws(spark, sf_dir):
    """Three numbers of each index's stream, below different bounds."""
    @F.pandas_udf("array<long>")
    def draws(keys: pd.Series) -> pd.Series:
        s = IndexStream(keys.to_numpy(np.uint64))
        return pd.Series(list(np.stack([s.draw(10), s.draw(7), s.draw(1_000_000)], axis=1)))

    at = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), draws("c_custkey").alias("d"))
    return at.select("id", F.col("d")[0].alias("a"), F.col("d")[1].alias("b"), F.col("d")[2].alias("c"))


@query(f"SELECT t AS type, CAST({sql_index('t')} % 1000000 AS BIGINT) AS seed FROM (SELECT lower(n_name) AS t FROM nation)")
def domain_seeds(spark, sf_dir):
    """The seed of a permutation, from its type's name."""
    rows = [(r["n_name"].lower(), secret().index(r["n_name"].lower()) % 1_000_000) for r in _rows(spark, sf_dir, "nation", "n_name")]
    return _frame(spark, rows, "type string, seed long")


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey <= 1 THEN 'SingleValue' WHEN n_nationkey = 2 THEN 'TwoValuesOnlySwap' WHEN n_nationkey % 5 = 0 THEN 'DuplicateValues' ELSE '' END AS reason FROM nation")
def degenerate_domains(spark, sf_dir):
    """Domains that are not permuted, and why: the first n nations, some with a name twice."""
    names = [r["n_name"] for r in _rows(spark, sf_dir, "nation", "n_nationkey", "n_name")]
    out = []
    for k in range(len(names)):
        values = names[:k] if k % 5 or not k else [*names[:k], names[0]]
        try:
            made, reason = derangement(values, k), ""
            assert all(a != b for a, b in made.items()) and sorted(made.values()) == sorted(values)
        except NoDerangement as e:
            reason = e.reason
        out.append((k, reason))
    return _frame(spark, out, "id int, reason string")


@query("SELECT r_regionkey AS id, CASE WHEN r_regionkey = 0 THEN 'NoPerfectMatching' WHEN r_regionkey = 1 THEN 'MatchingIsUnique' ELSE '' END AS reason FROM region")
def constrained_domains(spark, sf_dir):
    """Constraints without any permutation, with a single one, and with several."""
    names = [r["r_name"] for r in _rows(spark, sf_dir, "region", "r_regionkey", "r_name")]
    n, out = len(names), []
    for k in range(n):
        steps = [1] if k == 1 else list(range(1, k + 1)) or []
        allowed = {v: [names[(i + s) % n] for s in steps] if k else [names[0]] for i, v in enumerate(names)}
        try:
            made, reason = constrained_derangement(names, allowed, 7), ""
            assert all(b in allowed[a] for a, b in made.items())
        except NoDerangement as e:
            reason = e.reason
        out.append((k, reason))
    return _frame(spark, out, "id int, reason string")


# ---------------------------------------------------------------- rule packs and policies


@query("SELECT t AS type, CAST(n AS BIGINT) AS values FROM (VALUES " + ", ".join(f"('{t}', " + " + ".join(" * ".join(f"len({sql_list(PACK.components[c])})::HUGEINT" for c in p.components) for p in patterns) + ")" for t, patterns in PACK.templates.items()) + ") v(t, n)")
def pool_cardinality(spark, sf_dir):
    return _frame(spark, [(t, PACK.cardinality(t)) for t in PACK.templates], "type string, values long")


@query("SELECT r_name AS name, len(r_name) + 2 AS parts, 2 AS components FROM region")
def template_parts(spark, sf_dir):
    """Templates of as many single letters as a name has, with a component at either end."""
    out = []
    for r in _rows(spark, sf_dir, "region", "r_name"):
        inner = [c for c in r["r_name"]]
        t = Template("{a}" + "".join(inner) + "{b}")
        letters = sum(len(text) for is_component, text in t.parts if not is_component)
        out.append((r["r_name"], letters + len(t.components), len(t.components)))
    return _frame(spark, out, "name string, parts long, components int")


@query("SELECT n_nationkey AS id, n_nationkey % 5 > 0 AS refused FROM nation")
def template_errors(spark, sf_dir):
    """Nested, open and closed braces without partner, and patterns without component, are refused."""
    forms = ("{%s} x", "{%s", "%s}", "{a{%s}}", "%s")
    return _frame(spark, [(r["n_nationkey"], _fails(Template, forms[r["n_nationkey"] % 5] % r["n_name"])) for r in _rows(spark, sf_dir, "nation", "n_nationkey", "n_name")], "id int, refused boolean")


def _pack(names: list[str], fault: int) -> str:
    """A rule pack over names, with one of several faults (0: none)."""
    rules = [{"semanticType": "thing", "rank": 1, "namePatterns": ["^thing"], "valuePattern": "^[A-Z]"}, {"semanticType": " Other ", "rank": 1 if fault == 5 else 2}]
    components = {"name": [*names, names[0]] if fault == 1 else names, "empty": [] if fault == 2 else ["x"]}
    templates = {"thing": [] if fault == 3 else ["{missing}" if fault == 4 else "{name}-{empty}"]}
    return json.dumps({"version": "v", "rules": [] if fault == 6 else rules, "components": components, "templates": templates})


@query("SELECT n_nationkey AS id, n_nationkey % 7 > 0 AS refused FROM nation")
def pack_validation(spark, sf_dir):
    """Repeated and empty components, types without or with unknown templates, equal ranks and no rules."""
    rows = _rows(spark, sf_dir, "nation", "n_nationkey", "n_name")
    names = [r["n_name"] for r in rows]
    return _frame(spark, [(r["n_nationkey"], _fails(RulePack.from_json, _pack(names, r["n_nationkey"] % 7))) for r in rows], "id int, refused boolean")


@query("SELECT count(*) AS names, count(*) AS cardinality, 'thing,other' AS types, sha256('{\"version\": \"v\", \"rules\": [{\"semanticType\": \"thing\", \"rank\": 1, \"namePatterns\": [\"^thing\"], \"valuePattern\": \"^[A-Z]\"}, {\"semanticType\": \" Other \", \"rank\": 2}], \"components\": {\"name\": [' || string_agg('\"' || n_name || '\"', ', ' ORDER BY n_name) || '], \"empty\": [\"x\"]}, \"templates\": {\"thing\": [\"{name}-{empty}\"]}}') AS fingerprint FROM nation")
def pack_load(spark, sf_dir):
    """A rule pack from its text; its fingerprint is the text's digest."""
    pack = RulePack.from_json(_pack([r["n_name"] for r in _rows(spark, sf_dir, "nation", "n_name")], 0))
    return _frame(spark, [(len(pack.components["name"]), pack.cardinality("thing"), ",".join(r.semantic_type for r in pack.rules), pack.fingerprint)], "names long, cardinality long, types string, fingerprint string")


@query("SELECT c_custkey AS id, regexp_matches(lower(c_name), 'customer#0+[0-9]*7$') AS by_name, regexp_matches(c_mktsegment, '^[A-M]') AS by_value FROM customer")
def rule_patterns(spark, sf_dir):
    """Names are matched whatever their case, values as they are."""
    pack = RulePack("v", [_rule()], {"x": ["y"]}, {"thing": ["{x}"]})
    rule = pack.rules[0]
    rows = table(spark, sf_dir, "customer")
    return rows.select(F.col("c_custkey").alias("id"), pack.name_matches(rule, F.col("c_name")).alias("by_name"), pack.value_matches(rule, F.col("c_mktsegment")).alias("by_value"))


def _rule():
    from palimpsest.plans.rulepack import Rule

    return Rule("thing", 1, names=["CUSTOMER#0+[0-9]*7$"], value="^[A-M]")


_RANKS = "(VALUES " + ", ".join(f"('{t}', {r})" for t, r in PACK.registry.ranks.items()) + ") r(t, k)"
_TYPES = sorted(PACK.registry.ranks)


@query(f"""WITH p AS (SELECT c_custkey AS id, unnest([{sql_list(_TYPES)}[c_custkey % {len(_TYPES)} + 1], {sql_list(_TYPES)}[c_custkey * 7 % {len(_TYPES)} + 1], 'zz' || c_custkey % 3]) AS t FROM customer)
SELECT id, arg_min(p.t, (coalesce(k, 1000000), p.t)) AS type FROM p LEFT JOIN {_RANKS} USING (t) GROUP BY id""")
def most_specific_type(spark, sf_dir):
    """Of several types the one with the least rank; types without rank come last."""
    k, types = F.col("c_custkey"), F.array(*[F.lit(t) for t in _TYPES])
    some = F.array(F.get(types, (k % len(_TYPES)).cast("int")), F.get(types, (k * 7 % len(_TYPES)).cast("int")), F.concat(F.lit("zz"), k % 3))
    return table(spark, sf_dir, "customer").select(k.alias("id"), TypeRegistry(PACK.registry.ranks).most_specific_of(some).alias("type"))


def _policy(spark, sf_dir, faults: bool) -> Policy:
    """A policy over the columns of customer and orders, by their ordinals."""
    columns = []
    for t in ("customer", "orders"):
        for k, f in enumerate(describe(table(spark, sf_dir, t), "public", t), 1):
            c = PolicyColumn(f.address, f.data_type)
            if k == 2:
                c = PolicyColumn(f.address, f.data_type, True, "full_name", "Typed", "Dictionary")
            if k == 3:
                c = PolicyColumn(f.address, f.data_type, True, "status", "Typed", "Derangement")
            if faults and k == 1:
                c.strategy = "Function"
            if faults and k == 4:
                c.needs_approval = True
            if faults and k == 5:
                c = PolicyColumn(f.address, f.data_type, True)
            columns.append(c)
    return Policy("s", "a", columns)


_BOTH = f"(SELECT 'public.' || table_name || '.' || column_name AS name, ordinal FROM ({sql_columns('customer')} UNION ALL {sql_columns('orders')}))"


@query(f"""SELECT name, 'a strategy on a column that is not sensitive' AS problem FROM {_BOTH} WHERE ordinal = 1 UNION ALL SELECT name, 'a strategy without a semantic type' FROM {_BOTH} WHERE ordinal = 1
UNION ALL SELECT name, 'waits for approval' FROM {_BOTH} WHERE ordinal = 4 UNION ALL SELECT name, 'sensitive, but neither a strategy nor a reason' FROM {_BOTH} WHERE ordinal = 5""")
def policy_problems(spark, sf_dir):
    return _frame(spark, [tuple(p.split(": ", 1)) for p in _policy(spark, sf_dir, True).problems()], "name string, problem string")


@query(f"SELECT name, ordinal % 2 = 1 AS sensitive, CASE WHEN ordinal % 2 = 1 THEN 'city' ELSE 'unknown' END AS type, CASE WHEN ordinal % 2 = 0 THEN 'None' WHEN ordinal = 5 THEN 'Function' WHEN ordinal = 3 THEN 'Derangement' ELSE 'Function' END AS strategy, 'Human' AS source, false AS needs_approval FROM {_BOTH}")
def approvals(spark, sf_dir):
    """People's decisions in place of the policy's own, faults and all."""
    policy = _policy(spark, sf_dir, True)
    given = []
    for c in policy.columns:
        ordinal = [x.address for x in policy.columns if x.address.table == c.address.table].index(c.address) + 1
        given.append(Approval(c.address.qualified, ordinal % 2 == 1, "City" if ordinal % 2 else "unknown", mode="TextWipe" if ordinal == 5 else None, accepted_by="me"))
    done = policy.approved(given)
    return _frame(spark, [(c.address.qualified, c.sensitive, c.semantic_type, c.strategy, c.source, c.needs_approval) for c in done.columns], "name string, sensitive boolean, type string, strategy string, source string, needs_approval boolean")


@query(f"SELECT row_number() OVER (ORDER BY name) AS place, name, CASE ordinal WHEN 2 THEN 'full_name' ELSE 'status' END AS domain, CASE ordinal WHEN 3 THEN (SELECT list(DISTINCT o_orderstatus ORDER BY o_orderstatus) FROM orders) ELSE [] END AS allowed FROM {_BOTH} WHERE ordinal IN (2, 3)")
def table_plans(spark, sf_dir):
    """Columns by table and by domain, in order of their names; lists of a domain are intersected."""
    policy = _policy(spark, sf_dir, False)
    listed = [r["o_orderstatus"] for r in table(spark, sf_dir, "orders").select("o_orderstatus").distinct().collect()]
    plan = build_plan(policy, {c.address: [*listed, c.address.table] for c in policy.columns if c.strategy == "Derangement"})
    domain = {c.address: d for d in plan.domains for c in d.members}
    rows = [(c.address.qualified, domain[c.address].semantic_type, list(domain[c.address].allowed)) for columns in plan.tables.values() for c in columns]
    return _frame(spark, [(i, *r) for i, r in enumerate(rows, 1)], "place long, name string, domain string, allowed array<string>")


@query(f"SELECT 'public.' || t AS \"table\", c AS \"column\", CASE k WHEN 2 THEN 'full_name' ELSE 'status' END AS semantic_type, CASE k WHEN 2 THEN 'Dictionary' ELSE 'Derangement' END AS strategy FROM (SELECT table_name AS t, column_name AS c, ordinal AS k FROM ({sql_columns('customer')} UNION ALL {sql_columns('orders')})) WHERE k IN (2, 3)")
def table_plan_files(spark, sf_dir):
    """The plan of each table in a file of its own, read back from there."""
    policy = _policy(spark, sf_dir, False)
    plan = build_plan(policy, {c.address: ["x", "y", "z"] for c in policy.columns if c.strategy == "Derangement"})
    folder = _folder(spark)
    for t, text in plan_files(plan).items():
        lifecycle._write_text(spark, f"{folder}/{t}.json", text)
    rows = spark.read.schema("table string, columns array<struct<column:string,semantic_type:string,strategy:string>>").json(folder)
    return rows.select("table", F.explode("columns").alias("c")).select("table", "c.column", "c.semantic_type", "c.strategy")


@query("SELECT c_custkey AS id, k AS number, p_partkey AS part FROM customer, (SELECT unnest([1, 2, 3]) AS k) JOIN part ON p_partkey = (c_custkey * 7 + k) % (SELECT count(*) FROM part) ORDER BY 1, 2")
def seed_joins(spark, sf_dir):
    """Test rows for every customer and a short series, joined with parts on a computed key."""
    part = table(spark, sf_dir, "part")
    series = table(spark, sf_dir, "customer").select("c_custkey", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("number"))
    at = series.withColumn("p_partkey", (F.col("c_custkey") * 7 + F.col("number")) % part.count())
    return at.join(part.select("p_partkey"), "p_partkey").select(F.col("c_custkey").alias("id"), "number", F.col("p_partkey").alias("part"))


@query(f"SELECT domain, CAST(count(*) AS INT) AS members FROM (SELECT CASE ordinal WHEN 2 THEN 'full_name' ELSE 'status' END AS domain FROM {_BOTH} WHERE ordinal IN (2, 3)) GROUP BY domain")
def domains_of_a_plan(spark, sf_dir):
    policy = _policy(spark, sf_dir, False)
    plan = build_plan(policy, {c.address: ["x", "y", "z"] for c in policy.columns if c.strategy == "Derangement"})
    return _frame(spark, [(d.semantic_type, len(d.members)) for d in plan.domains], "domain string, members int")


@query("SELECT count(*) AS checks, count(*) FILTER (n_nationkey % 4 = 0 AND n_nationkey % 3 > 0) AS failed_blocking, count(*) FILTER (n_nationkey % 4 = 0 AND n_nationkey % 3 > 0) = 0 AS publishable, (SELECT 1 - count(*) FILTER (c_custkey % 5 = 0) / count(*) FROM customer WHERE c_custkey < 100) AS model_share, true AS names_risks FROM nation")
def passport_verdict(spark, sf_dir):
    """A passport counts failed checks that block, and the share of content that comes from the rule pack."""
    checks = [CheckResult("F-1", r["n_name"], r["n_nationkey"] % 4 > 0, r["n_nationkey"] % 3 > 0) for r in _rows(spark, sf_dir, "nation", "n_nationkey", "n_name")]
    keys = [r["c_custkey"] for r in table(spark, sf_dir, "customer").where("c_custkey < 100").select("c_custkey").collect()]
    columns = [PolicyColumn(Address("s", "t", f"c{k}"), "string", True, "snils" if k % 5 == 0 else "full_name", "Typed", "Function") for k in keys]
    p = build_passport("run", Policy("s", "a", columns, exceptions=["x"]), checks, [])
    return _frame(spark, [(len(p.checks), p.failed_blocking, p.publishable, p.model_share, "exception: x" in p.risks)], "checks long, failed_blocking long, publishable boolean, model_share double, names_risks boolean")


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey % 4 = 1 THEN 'no generator' WHEN n_nationkey % 4 = 2 THEN 'no validator' WHEN n_nationkey % 4 = 3 THEN 'refused' ELSE '' END AS problem FROM nation")
def run_preflight(spark, sf_dir):
    """What would go wrong, found before a run: no generator, no validator, spots within a text."""
    pack = PACK.with_renderer("badge", lambda s: s.draw(10).astype(str))
    types = ("full_name", "nothing", "badge", "full_name")
    out = []
    for r in _rows(spark, sf_dir, "nation", "n_nationkey"):
        k = r["n_nationkey"] % 4
        column = PolicyColumn(Address("s", "t", "c"), "string", True, types[k], "TextSpot" if k == 3 else "Typed", "Function")
        found = _preflights.get(k)
        if found is None:
            found = _preflights[k] = preflight(Plan({"s.t": [column]}, [], {}), pack, spark)
        text = found[0] if found else ""
        out.append((r["n_nationkey"], "refused" if "not supported" in text else text.rpartition(": ")[2]))
    return _frame(spark, out, "id int, problem string")


_preflights: dict[int, list[str]] = {}


@query("SELECT n_nationkey AS id, n_nationkey % 3 > 0 AS refused FROM nation")
def component_guards(spark, sf_dir):
    """Codes have a fixed width and digits only."""
    values = [[f"{k % 100:02d}" for k in range(k, k + 3)] if k % 3 == 0 else [f"{k}x"] if k % 3 == 1 else [] for k in range(25)]
    return _frame(spark, [(r["n_nationkey"], _fails(codes, values[r["n_nationkey"]], 2, "c")) for r in _rows(spark, sf_dir, "nation", "n_nationkey")], "id int, refused boolean")


@query("SELECT n_nationkey AS id, n_nationkey * 4 < 32 AS too_short, true AS closed FROM nation")
def secret_guard(spark, sf_dir):
    """Secrets have 32 bytes or more, and are of no use once closed."""
    out = []
    for r in _rows(spark, sf_dir, "nation", "n_nationkey"):
        size = r["n_nationkey"] * 4
        short = _fails(Secret, b"k" * size)
        s = Secret(b"k" * max(size, 32))
        s.close()
        out.append((r["n_nationkey"], short, _fails(s.index, "x")))
    return _frame(spark, out, "id int, too_short boolean, closed boolean")


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey % 3 = 2 THEN 'refused' WHEN n_nationkey % 3 = 1 THEN 'none' ELSE 'found' END AS checksum FROM nation")
def checksum_names(spark, sf_dir):
    def state(name: str) -> str:
        try:
            return "found" if checksum(name) else "none"
        except ValueError:
            return "refused"

    return _frame(spark, [(r["n_nationkey"], state(("inn", "", "odd")[r["n_nationkey"] % 3])) for r in _rows(spark, sf_dir, "nation", "n_nationkey")], "id int, checksum string")


@query("SELECT n_name AS \"column\", 'free_text' AS type, n_nationkey % 2 = 0 AS needs_approval FROM nation")
def unmeasured_texts(spark, sf_dir):
    """Text columns that no detector has looked at go to a person."""
    rows = []
    for r in _rows(spark, sf_dir, "nation", "n_nationkey", "n_name"):
        share = -1.0 if r["n_nationkey"] % 2 == 0 else 0.9
        c = classify(PACK, Features(Address("public", "t", r["n_name"]), "text", rows=10, distinct=9, average_length=80.0, sample=["x"], text_hit_share=share))
        rows.append((r["n_name"], c.semantic_type, c.needs_approval))
    return _frame(spark, rows, "column string, type string, needs_approval boolean")


@query("""SELECT 'customer' AS "table", 'c_mktsegment' AS "column", count(*) AS rows, count(DISTINCT c_mktsegment) AS "distinct", CAST(0 AS DOUBLE) AS null_share, avg(length(c_mktsegment)) AS average_length, (SELECT list(v ORDER BY md5(v), v) FROM (SELECT DISTINCT c_mktsegment AS v FROM customer)) AS sample FROM customer
UNION ALL SELECT 'orders', 'o_orderpriority', count(*), count(DISTINCT o_orderpriority), CAST(0 AS DOUBLE), avg(length(o_orderpriority)), (SELECT list(v ORDER BY md5(v), v) FROM (SELECT DISTINCT o_orderpriority AS v FROM orders)) FROM orders""")
def profiled_columns(spark, sf_dir):
    """A database's profile: counts, lengths and samples of its columns."""
    db = lifecycle.Database({"customer": table(spark, sf_dir, "customer").select("c_mktsegment"), "orders": table(spark, sf_dir, "orders").select("o_orderpriority")}, {})
    rows = [(f.address.table, f.address.column, f.rows, f.distinct, f.null_share, f.average_length, f.sample) for f in lifecycle.profile(db, None)]
    return _frame(spark, rows, "table string, column string, rows long, distinct long, null_share double, average_length double, sample array<string>")


# ---------------------------------------------------------------- predicates and checks


@query("SELECT count(*) AS rows, count(*) FILTER (regexp_matches(v, '[^\\s]')) AS not_blank FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN repeat(' ', CAST(doc_id % 5 AS INT)) || chr(9) WHEN doc_id % 3 = 1 THEN text END AS v FROM documents)")
def blank_filter(spark, sf_dir):
    k = F.col("doc_id")
    v = F.when(k % 3 == 0, F.concat(F.repeat(F.lit(" "), (k % 5).cast("int")), F.lit("\t"))).when(k % 3 == 1, F.col("text"))
    return table(spark, sf_dir, "documents").select(v.alias("v")).agg(F.count("*").alias("rows"), F.count_if(profile.not_blank(F.col("v"))).alias("not_blank"))


@query("SELECT DISTINCT v AS needle FROM (SELECT c_name AS v FROM customer UNION ALL SELECT c_mktsegment FROM customer UNION ALL SELECT CAST(c_custkey AS VARCHAR) FROM customer) WHERE length(v) >= 6")
def needles_of_a_corpus(spark, sf_dir):
    return C.needles(table(spark, sf_dir, "customer"), ["c_name", "c_mktsegment", "c_custkey"])


@query("SELECT 'no mail ' || c_custkey AS value FROM customer WHERE c_custkey % 4 = 0 ORDER BY value LIMIT 10")
def offending_values(spark, sf_dir):
    """The first values that don't look like their type, which a failed check names."""
    mail = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("no mail "), "c_custkey")).otherwise(F.concat("c_custkey", F.lit("@x.example")))
    return C.offending(table(spark, sf_dir, "customer").select(mail.alias("mail")), "mail", "email")


@query("SELECT count(*) AS rows, count(DISTINCT c_name || c_mktsegment) AS spellings, count(*) FILTER (c_custkey % 10 = 0) > 0 AS found FROM customer")
def consistency_without_key(spark, sf_dir):
    """Tables without a key carry a row id through a rewrite, so one value with two replacements is found."""
    a = stage_table(table(spark, sf_dir, "customer").select("c_name", "c_mktsegment").withColumn(lifecycle.ROW, F.monotonically_increasing_id()), "keyless")
    b = a.withColumn("c_name", F.concat(F.lit("x"), "c_name")).withColumn("c_mktsegment", F.concat("c_mktsegment", F.pmod(F.xxhash64("c_name"), F.lit(2))))
    segment = PolicyColumn(Address("public", "customer", "c_mktsegment"), "string", True, "segment", "Typed", "Dictionary")
    failed = not C.check_consistency([(a, b, [lifecycle.ROW], segment)], "segment").passed
    name = PolicyColumn(Address("public", "customer", "c_name"), "string", True, "full_name", "Typed", "Dictionary")
    held = C.check_consistency([(a, b, [lifecycle.ROW], name)], "full_name").passed
    return a.agg(F.count("*").alias("rows"), F.count_distinct(F.concat("c_name", "c_mktsegment")).alias("spellings"), F.lit(failed and held).alias("found"))


@query("SELECT count(DISTINCT c_mktsegment) AS spellings, count(DISTINCT c_mktsegment) AS \"values\", false AS refused FROM customer UNION ALL SELECT 2 * count(DISTINCT c_mktsegment), count(DISTINCT c_mktsegment), true FROM customer")
def spellings_of_unique_values(spark, sf_dir):
    """Spellings of one value in a unique column would become one replacement, and are refused."""
    c = table(spark, sf_dir, "customer")
    both = c.select(F.lower("c_mktsegment").alias("m")).unionAll(c.select("c_mktsegment"))
    column = PolicyColumn(Address("public", "customer", "m"), "string", True, "email", "Typed", "Dictionary", "EmailAddress")
    out = []
    for df in (c.select(F.lower("c_mktsegment").alias("m")), both):
        found = C.check_spellings(df, column)
        n = df.agg(F.count_distinct("m"), F.count_distinct(canonical(F.col("m"), "EmailAddress"))).first()
        out.append((n[0], n[1], not found.passed))
    return _frame(spark, out, "spellings long, values long, refused boolean")


@query("SELECT 'passport.json' AS name, count(*) AS rows, true AS whole FROM customer")
def published_result(spark, sf_dir):
    """A manifest publishes a result with its passport in one step; a second one of the same run is refused."""
    c, words, columns = _words(spark, sf_dir)
    db = lifecycle.Database({"customer": rewrite_table(c, columns, words, PACK, secret())}, {})
    policy = Policy("s", "a", columns)
    run = lifecycle.Run(f"run-{uuid.uuid4().hex}", policy, build_plan(policy), db, build_passport("run", policy, [CheckResult("F-9", "volume", True, True)], []))
    area = _folder(spark)
    before, target = lifecycle.published(spark, area, run.run_id), lifecycle.publish(run, area)
    try:
        lifecycle.publish(run, area)
        again = True
    except FileExistsError:
        again = False
    names = [r["path"].rpartition("/")[2] for r in spark.read.format("binaryFile").option("pathGlobFilter", "passport.*").load(target).select("path").collect()]
    found = lifecycle.published(spark, area, run.run_id)
    n = spark.read.parquet(f"{found}/customer").count()
    return _frame(spark, [("passport.json", n, before is None and found == target and not again and sorted(names) == ["passport.json", "passport.md"])], "name string, rows long, whole boolean")


# ---------------------------------------------------------------- control data


def _store(spark: SparkSession) -> tuple[ControlStore, list[datetime]]:
    now = [datetime(2024, 1, 1, tzinfo=UTC)]
    store = ControlStore(spark, _folder(spark), lambda: now[0])
    for who, role in (("own", "owner"), ("op", "operator"), ("con", "consumer")):
        store.add_identity(who, role)
    return store, now


def _refused(f, *args) -> bool:
    try:
        f(*args)
    except (Refused, ValueError, KeyError):
        return True
    return False


@query("SELECT lower(r_name) AS id, r_regionkey % 2 = 0 AS enabled FROM region")
def registered_sources(spark, sf_dir):
    """Sources registered by an operator, some of them taken off the offer; a consumer registers nothing."""
    store, _ = _store(spark)
    for r in _rows(spark, sf_dir, "region", "r_regionkey", "r_name"):
        name = re.sub(r"\W", "_", r["r_name"].lower())
        assert _refused(store.register, "con", "sources", name, "x", "parquet") and _refused(store.register, "op", "sources", f"{name} !", "x", "parquet")
        store.register("op", "sources", name, r["r_name"], "parquet")
        if r["r_regionkey"] % 2:
            store.disable("op", "sources", name)
    return store.table("sources").select(F.regexp_replace("id", "_", " ").alias("id"), "enabled")


@query("SELECT CAST(r_regionkey + 1 AS BIGINT) AS id, CASE r_regionkey WHEN 0 THEN 'done' WHEN 1 THEN 'rejected' WHEN 2 THEN 'failed' WHEN 3 THEN 'running' ELSE 'queued' END AS status, r_regionkey = 0 AS publishable, CASE WHEN r_regionkey < 4 THEN 'run-' || r_regionkey END AS run_id FROM region")
def request_states(spark, sf_dir):
    """Requests made, taken by one worker each, finished or failed."""
    store, _ = _store(spark)
    for side in ("sources", "sinks"):
        store.register("op", side, "x", "X", "parquet")
        store.announce(side, ["x"])
    rows = _rows(spark, sf_dir, "region", "r_regionkey")
    for _ in rows:
        store.request("op", "x", "x", "test")
    for r in rows[:4]:
        store.take(f"run-{r['r_regionkey']}")
    store.finish(1, "{}", True)
    store.finish(2, "{}", False)
    store.fail(3, "no")
    assert not store._claim(1, "other") and store.passport(1) == "{}" and store.passport(5) == "queued"
    return store.table("requests").select("id", "status", F.coalesce("publishable", F.lit(False)).alias("publishable"), "run_id")


@query("SELECT 'con' AS recipient, CAST(1 AS BIGINT) AS request_id, true AS granted, true AS refused_when_revoked, true AS granted_again, true AS refused_when_stale, (SELECT count(*) FROM region) AS exported")
def grants_and_downloads(spark, sf_dir):
    """A grant opens a result, a revocation closes it, every access is audited, and an export copies it."""
    store, now = _store(spark)
    for side in ("sources", "sinks"):
        store.register("op", side, "x", "X", "parquet")
        store.announce(side, ["x"])
    store.request("op", "x", "x", "test")
    now[0] += timedelta(minutes=3)
    stale = _refused(store.request, "op", "x", "x", "test")
    store.take("run-1")
    assert _refused(store.grant, "own", 1, "con")
    store.finish(1, "{}", True)
    area, out = _folder(spark), _folder(spark)
    table(spark, sf_dir, "region").write.parquet(f"{area}/run-1/region")
    assert _refused(store.download, "con", 1, area) and _refused(store.grant, "op", 1, "con")
    store.grant("own", 1, "con")
    first = store.download("con", 1, area) == f"{area}/run-1"
    store.revoke("own", 1, "con")
    closed = _refused(store.export, "con", 1, area, out)
    store.grant("own", 1, "con")
    n = spark.read.parquet(f"{store.export('con', 1, area, out)}/region").count()
    audit = store.table("audit").groupBy("action").count().where("action in ('download', 'download refused')").collect()
    return _frame(spark, [("con", 1, first, closed, {r["action"]: r["count"] for r in audit} == {"download": 2, "download refused": 2}, stale, n)], "recipient string, request_id long, granted boolean, refused_when_revoked boolean, granted_again boolean, refused_when_stale boolean, exported long")


# ---------------------------------------------------------------- streams


@query(f"SELECT c_custkey, replacement AS c_name, c_acctbal FROM customer JOIN ({_NAMES}) ON key = rtrim(c_name, ' ')")
def rewrite_as_stream(spark, sf_dir):
    """The batch rewrite on a stream: row by row, against a dictionary that all workers share."""
    c, words, columns = _words(spark, sf_dir)
    folder = _folder(spark)
    c.select("c_custkey", "c_name", "c_acctbal").repartition(3).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema("c_custkey long, c_name string, c_acctbal double").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    start(rewrite_stream(stream, columns, stage_table(words, "words"), PACK, secret()), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@query("SELECT count(*) AS rows, true AS stopped, true AS resumed FROM customer")
def stream_restart(spark, sf_dir):
    """A value that fails its column's kind stops a stream; a restart goes on behind what was written, without repeats."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("k"))
    folder = _folder(spark)
    column = PolicyColumn(Address("s", "t", "k"), "string", True, "snils", "Typed", "Function", "Integer")
    none = _frame(spark, [], "key string, replacement string")
    c.where("cast(k as long) % 2 = 0").coalesce(1).write.parquet(f"{folder}/in/a")

    def go(lost: bool = False):
        stream = spark.readStream.schema("k string").option("recursiveFileLookup", "true").option("ignoreMissingFiles", lost).parquet(f"{folder}/in")
        return start(rewrite_stream(stream, [column], none, PACK, secret()), f"{folder}/out", f"{folder}/checkpoint")

    go().awaitTermination()
    first = spark.read.parquet(f"{folder}/out").count()
    _frame(spark, [("no number",)], "k string").coalesce(1).write.parquet(f"{folder}/in/b")
    bad = go()
    try:
        bad.awaitTermination()
        stopped = False
    except Exception:
        stopped = bad.exception() is not None
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/in/b")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    c.where("cast(k as long) % 2 = 1").coalesce(1).write.parquet(f"{folder}/in/b")
    for _ in range(2):
        go(lost=True).awaitTermination()  # the bad file is gone for good
    n = spark.read.parquet(f"{folder}/out").where(valid(F.col("k"), "snils")).count()
    return _frame(spark, [(n, stopped, first < n)], "rows long, stopped boolean, resumed boolean")
