"""The engine's operators as queries over the test tables, with DuckDB SQL of the same result.

The secret and the derived columns here are for tests; operators get theirs from their callers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest import control
from palimpsest.functions import prf
from palimpsest.functions.canonical import canonical
from palimpsest.functions.validators import valid_inn, valid_snils
from palimpsest.operators import checks as C
from palimpsest.operators import detect, dictionary, document, generators, profile
from palimpsest.operators.containment import candidates, mark_of, matches, prepared
from palimpsest.operators.derange import constrained_derangement
from palimpsest.operators.rewrite import resolve, rewrite_table
from palimpsest.plans.classify import classify
from palimpsest.plans.model import Address, Features, PolicyColumn
from palimpsest.plans.storage import stage_table
from palimpsest.registry import ORACLE_SQL, PACK, QUERIES, digit_sum, query, secret, sql_bijection, sql_columns, sql_derangement, sql_hmac, sql_index, sql_key, sql_keys, sql_rendered, table
from palimpsest.sources.introspect import Constraints, describe, domain_literals, list_columns, schema_fingerprint, unique_columns


# ---------------------------------------------------------------- canonical forms


def _canonical(raw: Callable[[], Column], kind: str, of: str, key: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, of).select(F.col(key).alias("id"), raw().alias("raw"))
        return df.select("id", canonical(F.col("raw"), kind).alias("canonical"))

    return run


def _k() -> Column:
    return F.col("c_custkey")


def _sp() -> Column:
    """Up to three trailing or leading spaces."""
    return F.repeat(F.lit(" "), (_k() % 4).cast("int"))


query("SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_name END AS canonical FROM customer", "canonical_text")(
    _canonical(lambda: F.concat(F.when(_k() % 7 == 0, "").otherwise(F.col("c_name")), _sp()), "Text", "customer", "c_custkey"))
query("SELECT c_custkey AS id, lower('User' || c_custkey || '@Example.RU') AS canonical FROM customer", "canonical_email")(
    _canonical(lambda: F.concat(F.lit("User"), _k(), F.lit("@Example.RU"), _sp()), "EmailAddress", "customer", "c_custkey"))
query("SELECT c_custkey AS id, CASE WHEN c_custkey = 0 THEN '0' ELSE CASE WHEN c_custkey % 3 = 0 THEN '-' ELSE '' END || c_custkey || '00000000000000000000000' END AS canonical FROM customer", "canonical_integer")(
    _canonical(lambda: F.concat(_sp(), F.when(_k() % 3 == 0, "-").when(_k() % 3 == 1, "+").otherwise(""), F.lit("000"), _k(), F.repeat(F.lit("0"), F.lit(23))), "Integer", "customer", "c_custkey"))
query("""SELECT o_orderkey AS id, CASE o_orderkey % 3
  WHEN 0 THEN rtrim(rtrim(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), '0'), '.')
  WHEN 1 THEN CAST(o_orderkey AS VARCHAR) || '000' ELSE '-0.00' || o_orderkey || '7' END AS canonical FROM orders""", "canonical_decimal")(
    _canonical(lambda: F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("00"), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("000")))
               .when(F.col("o_orderkey") % 3 == 1, F.concat(F.col("o_orderkey").cast("string"), F.lit(".0e3")))
               .otherwise(F.concat(F.lit("-0"), F.col("o_orderkey"), F.lit("."), F.lit("7E-"), F.length(F.col("o_orderkey").cast("string")) + 2)), "Decimal", "orders", "o_orderkey"))
query("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END AS canonical FROM customer", "canonical_boolean")(
    _canonical(lambda: F.element_at(F.array(*[F.lit(x) for x in (" YES", "No", "T ", "0", "1", "n")]), (_k() % 6 + 1).cast("int")), "Boolean", "customer", "c_custkey"))
query("""SELECT o_orderkey AS id, strftime(o_orderdate - CASE WHEN o_orderkey % 2 = 0 THEN INTERVAL 3 HOUR ELSE INTERVAL 0 HOUR END, '%Y-%m-%dT%H:%M:%S.%f') || CASE WHEN o_orderkey % 2 = 0 THEN '7Z' ELSE '0Z' END AS canonical FROM orders""", "canonical_timestamp")(
    _canonical(lambda: F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.when(F.col("o_orderkey") % 2 == 0, "7+03:00").otherwise("")), "Timestamp", "orders", "o_orderkey"))
query("SELECT c_custkey AS id, lower(hex(encode(c_name))) AS canonical FROM customer", "canonical_binary")(
    _canonical(lambda: F.concat(F.when(_k() % 2 == 0, "\\x").otherwise("0X"), F.hex("c_name")), "Binary", "customer", "c_custkey"))


# ---------------------------------------------------------------- keyed functions


@query(f"SELECT c_custkey AS id, substr({sql_hmac(sql_key('c_name'))}, 1, 16) AS index_hex FROM customer")
def prf_index(spark, sf_dir):
    return secret().keyed(table(spark, sf_dir, "customer")).select(F.col("c_custkey").alias("id"), prf.index_hex(F.col("c_name")).alias("index_hex"))


@query(f"SELECT c_custkey AS id, {sql_hmac('encode(c_name)')} AS fingerprint FROM customer")
def value_fingerprint(spark, sf_dir):
    return secret().keyed(table(spark, sf_dir, "customer")).select(F.col("c_custkey").alias("id"), prf.fingerprint(F.col("c_name")).alias("fingerprint"))


@query("SELECT c_custkey AS id, substr(" + sql_hmac(sql_key("c_name", "'full_name'")) + ", 1, 16) AS index_hex FROM customer")
def exception_key(spark, sf_dir):
    return secret().keyed(table(spark, sf_dir, "customer")).select(F.col("c_custkey").alias("id"), prf.index_hex(F.col("c_name"), F.lit("full_name")).alias("index_hex"))


CITY_SQL = f"SELECT id, value AS city FROM ({sql_rendered('SELECT c_custkey AS id, c_custkey::UHUGEINT * 1000003 AS idx FROM customer', 'city')})"


@query(CITY_SQL)
def index_stream_city(spark, sf_dir):
    index = F.lpad(F.hex(F.col("c_custkey") * 1000003), 16, "0")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), generators.rendered(PACK, "city", index).alias("city"))


# ---------------------------------------------------------------- renderers and validators

RENDERED = ("inn_person", "inn_legal", "snils", "phone", "passport", "birth_date", "full_name", "email", "city", "postal_address", "free_text")


def _render(semantic_type: str):
    def run(spark, sf_dir):
        at = secret().keyed(table(spark, sf_dir, "orders").select("o_orderkey")).select(F.col("o_orderkey").alias("id"), prf.index_hex(F.col("o_orderkey").cast("string")).alias("index"))
        return at.select("id", generators.rendered(PACK, semantic_type, F.col("index")).alias("value"))

    return run


_ORDERS = f"SELECT o_orderkey AS id, {sql_index('CAST(o_orderkey AS VARCHAR)')} AS idx FROM orders"
for _t in RENDERED:
    query(f"SELECT id, value FROM ({sql_rendered(_ORDERS, _t)})", f"render_{_t}")(_render(_t))


@query("SELECT type, n, n AS n_valid FROM (SELECT count(*) AS n FROM customer), (VALUES " + ", ".join(f"('{t}')" for t in RENDERED) + ") t(type)")
def rendered_values_are_plausible(spark, sf_dir):
    """Every renderer's values look like their type to its validator."""
    from palimpsest.functions.validators import valid

    at = secret().keyed(table(spark, sf_dir, "customer")).select(prf.index_hex(F.col("c_custkey").cast("string")).alias("index"))
    parts = [at.select(generators.rendered(PACK, t, F.col("index")).alias("value")).agg(F.lit(t).alias("type"), F.count("*").alias("n"), F.count_if(valid(F.col("value"), t)).alias("n_valid")) for t in RENDERED]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


@query(f"""WITH d AS (SELECT o_orderkey AS id, lpad(CAST(o_orderkey * 7919 % 10000000000 AS VARCHAR), 10, '0') AS ten,
  lpad(CAST(o_orderkey * 104729 % 100000000000 AS VARCHAR), 11, '0') AS eleven FROM orders),
s AS (SELECT *, {digit_sum("eleven", (9, 8, 7, 6, 5, 4, 3, 2, 1))} AS total FROM d)
SELECT id, ({digit_sum("ten", (2, 4, 10, 3, 5, 9, 4, 6, 8))}) % 11 % 10 = CAST(substr(ten, 10, 1) AS INT) AS inn_ok,
  CAST(substr(eleven, 10, 2) AS INT) = CASE WHEN total < 100 THEN total WHEN total <= 101 THEN 0 ELSE total % 101 % 100 END AS snils_ok FROM s""")
def validate_checksums(spark, sf_dir):
    k = F.col("o_orderkey")
    ten = F.lpad((k * 7919 % 10000000000).cast("string"), 10, "0")
    eleven = F.lpad((k * 104729 % 100000000000).cast("string"), 11, "0")
    dashed = F.concat(F.substring(eleven, 1, 3), F.lit("-"), F.substring(eleven, 4, 3), F.lit("-"), F.substring(eleven, 7, 3), F.lit(" "), F.substring(eleven, 10, 2))
    return table(spark, sf_dir, "orders").select(k.alias("id"), valid_inn(ten).alias("inn_ok"), valid_snils(dashed).alias("snils_ok"))


@query("SELECT 'email' AS type, count(*) AS rows, count(*) AS plausible FROM customer UNION ALL SELECT 'phone', count(*), count(*) FILTER (c_custkey % 3 = 0) FROM customer UNION ALL SELECT 'birth_date', count(*), count(*) FILTER (c_custkey % 2 = 0) FROM customer")
def validate_values(spark, sf_dir):
    from palimpsest.functions.validators import valid

    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(
        F.concat(k, F.lit("@mail.example")).alias("email"),
        F.when(k % 3 == 0, F.concat(F.lit("+7"), F.lpad(k.cast("string"), 10, "0"))).otherwise(F.concat(F.lit("8"), F.lpad(k.cast("string"), 10, "0"))).alias("phone"),
        F.when(k % 2 == 0, "2000-02-29").otherwise("1999-02-29").alias("birth_date"),
    )
    parts = [c.agg(F.lit(t).alias("type"), F.count("*").alias("rows"), F.count_if(valid(F.col(t), t)).alias("plausible")) for t in ("email", "phone", "birth_date")]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


# ---------------------------------------------------------------- profiles and scans

_AGG = "SELECT '{c}' AS \"column\", count(*) AS rows, count({c}) AS non_null, count(DISTINCT CAST({c} AS VARCHAR)) AS distinct_values, coalesce(avg(length(CAST({c} AS VARCHAR))), 0) AS average_length, CASE WHEN count(*) = 0 THEN 0.0 ELSE (count(*) - count({c})) / count(*) END AS null_share FROM {t}"


def _profile_sql(of: str, columns: list[str]) -> str:
    return " UNION ALL ".join(_AGG.format(c=c, t=of) for c in columns)


@query(_profile_sql("customer", ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]))
def column_aggregate(spark, sf_dir):
    return profile.aggregates(table(spark, sf_dir, "customer"), ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"], exact=True)


@query(_profile_sql("lineitem", ["l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus"]))
def column_aggregate_lineitem(spark, sf_dir):
    return profile.aggregates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus"], exact=True)


@query("SELECT event_type AS type, count(*) AS rows, count(CASE WHEN user_id % 3 > 0 THEN 1 END) AS non_null, (count(*) - count(CASE WHEN user_id % 3 > 0 THEN 1 END)) / count(*) AS null_share FROM events GROUP BY event_type")
def null_share(spark, sf_dir):
    out = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("type")).agg(F.count("*").alias("rows"), F.count(F.when(F.col("user_id") % 3 > 0, 1)).alias("non_null"))
    return out.withColumn("null_share", profile.null_share(F.col("rows"), F.col("non_null")))


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS rows, count({c}) AS non_null, count(DISTINCT {c}) AS exact, true AS close FROM orders" for c in ("o_orderkey", "o_custkey", "o_orderstatus")))
def approx_distinct(spark, sf_dir):
    """Estimates of distinct values, and whether they come within 5 % of the exact ones."""
    o = table(spark, sf_dir, "orders")
    names = ["o_orderkey", "o_custkey", "o_orderstatus"]
    about = profile.aggregates(o, names, exact=False).select("column", "rows", "non_null", F.col("distinct_values").alias("about"))
    exact = profile.aggregates(o, names).select("column", F.col("distinct_values").alias("exact"))
    return about.join(exact, "column").select("column", "rows", "non_null", "exact", (F.abs(F.col("about") - F.col("exact")) <= 0.05 * F.col("exact")).alias("close"))


@query("SELECT 'customer' AS \"table\", count(*) AS rows FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem")
def row_counts(spark, sf_dir):
    parts = [table(spark, sf_dir, t).agg(F.lit(t).alias("table"), F.count("*").alias("rows")) for t in ("customer", "orders", "lineitem")]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query("SELECT DISTINCT c_name AS value FROM customer WHERE c_name IS NOT NULL ORDER BY md5(c_name), c_name LIMIT 200")
def distinct_sample(spark, sf_dir):
    return profile.distinct_sample(table(spark, sf_dir, "customer"), "c_name")


@query("SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS value FROM orders WHERE o_custkey IS NOT NULL")
def distinct_values(spark, sf_dir):
    return profile.distinct_values(table(spark, sf_dir, "orders"), "o_custkey")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS \"key\", o_orderpriority AS value FROM orders WHERE o_orderpriority IS NOT NULL ORDER BY CAST(o_orderkey AS VARCHAR) LIMIT 2000")
def keyed_values(spark, sf_dir):
    return profile.keyed_values(table(spark, sf_dir, "orders"), "o_orderkey", "o_orderpriority", 2000)


@query(" UNION ALL ".join(f"SELECT table_name, column_name, ordinal, data_type FROM ({sql_columns(t)})" for t in ("customer", "nation", "orders", "region")))
def describe_columns(spark, sf_dir):
    return list_columns(spark, {t: table(spark, sf_dir, t) for t in ("nation", "region", "orders", "customer")}, "public").select("table_name", "column_name", "ordinal", "data_type")


@query("SELECT 'c_custkey' AS \"column\" UNION ALL SELECT 'c_name' WHERE (SELECT count(*) = count(DISTINCT c_name) FROM customer)")
def candidate_keys(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return spark.createDataFrame([(x,) for x in unique_columns(c)], "column string")


@query("SELECT * FROM (VALUES ('status', ['new', 'it''s', 'done']), ('size', CAST([] AS VARCHAR[]))) t(name, \"values\")")
def finite_domain_extract(spark, sf_dir):
    rows = [("status", "CHECK ((status = ANY (ARRAY['new'::text, 'it''s'::text, 'done'::text])))"), ("size", "CHECK ((size > 0) AND ('a'::text <> 'b'::text))")]
    return spark.createDataFrame(rows, "name string, definition string").select("name", domain_literals(F.col("definition")).alias("values"))


@query(f"""SELECT sha256(string_agg(line, chr(10) ORDER BY line)) AS fingerprint FROM (
 SELECT 'public.nation.' || column_name || '|' || data_type || '|' || CASE WHEN nullable THEN 'null' ELSE 'not null' END || '|' || CASE ordinal WHEN 1 THEN 'pu' WHEN 2 THEN 'u' ELSE 'f' END
  || '|' || CASE ordinal WHEN 2 THEN 'the name' ELSE '' END || '|' AS line FROM ({sql_columns("nation")}))""")
def schema_fingerprint_nation(spark, sf_dir):
    found = describe(table(spark, sf_dir, "nation"), "public", "nation", Constraints(["n_nationkey"], [["n_name"]], {"n_regionkey": "region.r_regionkey"}, comments={"n_name": "the name"}))
    return spark.createDataFrame([(schema_fingerprint(found),)], "fingerprint string")


@query("SELECT avg(CAST(regexp_matches(url, '^https://') AS INT)) AS https_share, avg(CAST(contains(url, '?') AS INT)) AS query_share FROM pages")
def value_share_by_rule(spark, sf_dir):
    return table(spark, sf_dir, "pages").agg(profile.share(F.col("url").rlike("^https://")).alias("https_share"), profile.share(F.col("url").contains("?")).alias("query_share"))


# ---------------------------------------------------------------- classification and detection


@query("""SELECT * FROM (VALUES ('email', 'email', 0.865, 'Dictionary', false), ('phone_work', 'phone', 0.55, 'Dictionary', true), ('code', 'passport', 0.925, 'Dictionary', false),
 ('inn', 'inn_person', 0.99325, 'Function', false), ('city', 'city', 0.55, 'Dictionary', true), ('department', 'unknown', 0.0, 'None', false), ('note', 'free_text', 0.25, 'Function', false),
 ('marital', 'marital_status', 0.55, 'Derangement', true), ('remark', 'free_text', 0.0, 'Function', true)) t("column", type, confidence, strategy, needs_approval)""")
def classify_columns(spark, sf_dir):
    def f(column, kind, **more):
        return Features(Address("public", "t", column), kind, rows=10, **{"distinct": 9} | more)

    columns = [
        f("email", "varchar(120)", sample=["a@b.example"] * 10, is_unique=True), f("phone_work", "text", sample=["none"]), f("code", "char(11)", comment="паспорт: серия и номер", sample=["4001 123456"]),
        f("inn", "char(12)", comment="", sample=["500100732259"] * 9, distinct=200_000), f("city", "varchar(80)", sample=["Псков"]), f("department", "varchar(80)", sample=["Отдел № 1"]),
        f("note", "text", sample=["x"], text_hit_share=0.25), f("marital", "varchar(16)", finite_domain=["a", "b", "c"]), f("remark", "text"),
    ]
    rows = [(c.address.column, c.semantic_type, round(c.confidence, 6), c.strategy, c.needs_approval) for c in (classify(PACK, x) for x in columns)]
    return spark.createDataFrame(rows, "column string, type string, confidence double, strategy string, needs_approval boolean")


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '[\w.+-]+@[\w-]+(?:\.[\w-]+)+')) AS n_email, len(regexp_extract_all(text, '\+7[0-9]{10}')) AS n_phone FROM documents""")
def text_entity_hits(spark, sf_dir):
    found = detect.relevant(detect.entities(F.col("text")))
    of = table(spark, sf_dir, "documents").select("doc_id", found.alias("found"))

    def count(kind, plus):
        return F.size(F.filter("found", lambda e: (e["type"] == kind) & (e["text"].startswith("+7") if plus else F.lit(True)))).cast("long")

    return of.select("doc_id", count("EMAIL_ADDRESS", False).alias("n_email"), count("PHONE_NUMBER", True).alias("n_phone"))


def _near(words: list[str], pattern: str) -> str:
    """SQL: one of the words begins among the five words before a match."""
    return rf"regexp_matches(lower(value), '(?:{'|'.join(words)})[\pL\pN_]*[^\pL\pN_]+(?:[\pL\pN_]+[^\pL\pN_]+){{0,4}}(?:{pattern})')"


def _hit_share_sql(of: str, column: str) -> str:
    """The share of a sample in which some recogniser's score reaches what counts."""
    tests = []
    for r in detect.RECOGNISERS:
        if r.entity in detect.IGNORED:
            continue
        found = f"regexp_matches(value, '{r.pattern}')"
        tests.append(found if r.score >= detect.MIN_SCORE else _near(r.context, r.pattern))
    sample = f"SELECT DISTINCT {column} AS value FROM {of} WHERE {column} IS NOT NULL ORDER BY md5(value), value LIMIT {profile.DETECTOR_SAMPLE}"
    return f"SELECT '{of}' AS \"table\", '{column}' AS \"column\", avg(CAST({' OR '.join(tests)} AS DOUBLE)) AS hit_share FROM ({sample})"


_DETECTED = (("documents", "text"), ("conversations", "text"), ("customer", "c_name"))


@query(" UNION ALL ".join(_hit_share_sql(t, c) for t, c in _DETECTED))
def detector_hit_share(spark, sf_dir):
    shares = [(t, c, detect.hit_share(table(spark, sf_dir, t), c)) for t, c in _DETECTED]
    return spark.createDataFrame(shares, "table string, column string, hit_share double")


# ---------------------------------------------------------------- dictionaries and permutations


@query("SELECT DISTINCT v AS \"key\" FROM (SELECT c_name AS v FROM customer UNION ALL SELECT o_orderpriority FROM orders UNION ALL SELECT lower(c_mktsegment) FROM customer) WHERE trim(v) <> ''")
def domain_union_values(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return dictionary.domain_values([(c, "c_name", "Text"), (o, "o_orderpriority", "Text"), (c, "c_mktsegment", "EmailAddress")])


_NAMES = sql_bijection(sql_keys("customer", "c_name"), "full_name")


@query(_NAMES)
def dictionary_bijection(spark, sf_dir):
    keys = dictionary.domain_values([(table(spark, sf_dir, "customer"), "c_name", "Text")])
    return dictionary.bijection(keys, "full_name", PACK, secret())


@query(sql_bijection(sql_keys("orders", "CAST(o_orderkey % 3000 AS VARCHAR)"), "postal_address"))
def dictionary_bijection_distributed(spark, sf_dir):
    """By rounds of proposals, in a pool that is small enough for values to compete."""
    keys = dictionary.domain_values([(table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 3000).alias("k")), "k", "Text")])
    return dictionary.bijection(keys, "postal_address", PACK, secret(), small=0)


_SEGMENTS = sql_derangement("SELECT DISTINCT rtrim(c_mktsegment, ' ') AS v FROM customer WHERE rtrim(c_mktsegment, ' ') <> ''", "segment")
_STATUSES = sql_derangement("SELECT DISTINCT rtrim(o_orderstatus, ' ') AS v FROM orders WHERE rtrim(o_orderstatus, ' ') <> ''", "status")


@query(_SEGMENTS)
def derangement_segment(spark, sf_dir):
    keys = dictionary.domain_values([(table(spark, sf_dir, "customer"), "c_mktsegment", "Text")])
    return dictionary.permutation(keys, "segment", dictionary.listed(keys), secret())


@query("SELECT count(DISTINCT o_orderpriority) AS n, count(DISTINCT o_orderpriority) AS n_replacements, 0 AS n_unchanged, 0 AS n_forbidden FROM orders")
def constrained_derangement_priorities(spark, sf_dir):
    """Priorities permuted so that none takes itself or the one after it."""
    values = sorted(dictionary.listed(dictionary.domain_values([(table(spark, sf_dir, "orders"), "o_orderpriority", "Text")])))
    allowed = {v: [w for w in values if w not in (v, values[(i + 1) % len(values)])] for i, v in enumerate(values)}
    rows = [(k, v, v in allowed[k]) for k, v in constrained_derangement(values, allowed, secret().index("priority")).items()]
    made = spark.createDataFrame(rows, "key string, replacement string, ok boolean")
    return made.agg(F.count("*").alias("n"), F.count_distinct("replacement").alias("n_replacements"), F.count_if(F.col("key") == F.col("replacement")).cast("int").alias("n_unchanged"), F.count_if(~F.col("ok")).cast("int").alias("n_forbidden"))


_FUNCTION = f"SELECT key, value FROM ({sql_rendered(sql_keys('customer', 'c_name'), 'full_name')})"


@query(f"SELECT key, coalesce(word, value) AS replacement FROM ({_FUNCTION}) LEFT JOIN (SELECT c_name AS key, 'word ' || c_custkey AS word FROM customer WHERE c_custkey % 2 = 0) USING (key)")
def dictionary_lookup_resolve(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    listed = c.where("c_custkey % 2 = 0").select(F.col("c_name").alias("key"), F.concat(F.lit("word "), F.col("c_custkey")).alias("replacement"))
    return resolve(c.select(F.col("c_name").alias("key")), "full_name", listed, PACK, secret())


_EXCEPTED = f"SELECT key, {sql_index('key', repr('full_name'))} AS idx FROM (SELECT DISTINCT c_name AS key FROM customer WHERE c_custkey < 10)"


@query(f"SELECT key, coalesce(value, 'the word') AS replacement FROM (SELECT c_name AS key FROM customer) LEFT JOIN ({sql_rendered(_EXCEPTED, 'full_name')}) USING (key)")
def resolve_exceptions(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("key"))
    listed = c.select("key", F.lit("the word").alias("replacement"))
    marks = [secret().fingerprint(r["key"]) for r in c.where("c_custkey < 10").collect()]
    return resolve(c.select("key"), "full_name", listed, PACK, secret(), marks)


# ---------------------------------------------------------------- rewriting and checks


def _column(of: str, column: str, semantic_type: str, strategy: str = "Dictionary", mode: str = "Typed", **more) -> PolicyColumn:
    return PolicyColumn(Address("public", of, column), "varchar", True, semantic_type, mode, strategy, **more)


def rewritten_customer(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, list[PolicyColumn]]:
    """Customers before and after: names by dictionary, market segments by permutation."""
    c = table(spark, sf_dir, "customer")
    columns = [_column("customer", "c_name", "full_name"), _column("customer", "c_mktsegment", "segment", "Derangement")]
    names = dictionary.bijection(dictionary.domain_values([(c, "c_name", "Text")]), "full_name", PACK, secret())
    keys = dictionary.domain_values([(c, "c_mktsegment", "Text")])
    segments = dictionary.permutation(keys, "segment", dictionary.listed(keys), secret())
    words = dictionary.merged([names, segments])
    return c, rewrite_table(c, columns, words, PACK, secret()), columns


@query(f"SELECT c_custkey, n.replacement AS c_name, c_nationkey, c_acctbal, g.replacement AS c_mktsegment FROM customer JOIN ({_NAMES}) n ON n.key = rtrim(c_name, ' ') JOIN ({_SEGMENTS}) g ON g.key = rtrim(c_mktsegment, ' ')")
def rewrite_customer(spark, sf_dir):
    return rewritten_customer(spark, sf_dir)[1]


@query(f"SELECT o_orderkey, o_custkey, o_totalprice, replacement AS o_orderstatus FROM orders JOIN ({_STATUSES}) ON key = o_orderstatus")
def rewrite_orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    keys = dictionary.domain_values([(o, "o_orderstatus", "Text")])
    words = dictionary.permutation(keys, "status", dictionary.listed(keys), secret())
    out = rewrite_table(o, [_column("orders", "o_orderstatus", "status", "Derangement")], words, PACK, secret())
    return out.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")


_WIPED = f"SELECT conv_id, turn, text AS raw, {sql_index('rtrim(text, chr(32))')} AS idx FROM conversations"


@query(f"SELECT conv_id, turn, CASE WHEN rtrim(raw, ' ') <> '' THEN value ELSE raw END AS text FROM ({sql_rendered(_WIPED, 'free_text')})")
def text_wipe(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    none = spark.createDataFrame([], "key string, replacement string")
    return rewrite_table(t, [_column("conversations", "text", "free_text", "Function", "TextWipe")], none, PACK, secret()).select("conv_id", "turn", "text")


@query("""SELECT event_id, json_object('k', CAST(json_extract(props, '$.k') AS BIGINT), 'who', json_object('mail', 'x' || event_id), 'tags', json_array('t' || (event_id % 5), ' ')) AS doc FROM events""")
def document_rewrite(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit('{"k":'), F.get_json_object("props", "$.k"), F.lit(',"who":{"mail":"u'), F.col("event_id"), F.lit('@Example.ORG"},"tags":["tag'), F.col("event_id") % 5, F.lit('"," "]}')).alias("doc"))
    mails = e.select(F.lit("email").alias("type"), F.concat(F.lit("u"), F.col("event_id"), F.lit("@example.org")).alias("key"), F.concat(F.lit("x"), F.col("event_id")).alias("replacement"))
    tags = spark.range(5).select(F.lit("free_text").alias("type"), F.concat(F.lit("tag"), F.col("id")).alias("key"), F.concat(F.lit("t"), F.col("id")).alias("replacement"))
    return document.rewrite_documents(e, "doc", mails.unionByName(tags), {"who.mail": "email"}, {"email": "EmailAddress"})


@query("SELECT 'who.mail' AS path, count(*) AS texts, count(DISTINCT event_id) AS distinct_values FROM events UNION ALL SELECT 'tags', 2 * count(*), 4 FROM events")
def document_paths(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.concat(F.lit('{"k":1,"who":{"mail":"u'), F.col("event_id"), F.lit('"},"tags":["a'), F.col("event_id") % 3, F.lit('","b"]}')).alias("doc"))
    return document.path_summary(e, "doc").select("path", "texts", "distinct_values")


def _diversity(column: str) -> str:
    """Replacements are a bijection: as many values as before, and as many nulls."""
    n, share = f"count(DISTINCT {column})", f"printf('%.6f', 1 - count({column}) / count(*))"
    return f"SELECT 'F-10' AS requirement, 'diversity public.customer.{column}' AS name, true AS passed, {n} || ' values became ' || {n} || ', null share ' || {share} || ' became ' || {share} AS detail FROM customer"


@query(" UNION ALL ".join([
    _diversity("c_name"), _diversity("c_mktsegment"), "SELECT 'F-11', 'schema', true, ''", "SELECT 'F-9', 'volume customer', true, count(*) || ' rows became ' || count(*) FROM customer",
    f"SELECT 'F-4', 'completeness public.customer.c_name', count(*) = 0, count(*) || ' rows survive' FROM customer JOIN ({_NAMES}) ON key = rtrim(c_name, ' ') WHERE replacement = c_name",
    f"SELECT 'F-7', 'consistency full_name', count(*) = 0, count(*) || ' values have several replacements' FROM (SELECT key FROM ({_NAMES}) GROUP BY key HAVING count(DISTINCT replacement) > 1)",
    f"SELECT 'F-5', 'plausibility public.customer.c_name', count(*) = 0, count(*) || ' values are not plausible' FROM ({_NAMES}) WHERE NOT regexp_matches(replacement, '^[а-яёА-ЯЁ]+ [а-яёА-ЯЁ]+ [а-яёА-ЯЁ]+$')",
    f"SELECT 'R-3', 'derangement public.customer.c_mktsegment', count(*) = 0, count(*) || ' fixed points' FROM customer JOIN ({_SEGMENTS}) ON key = c_mktsegment WHERE replacement = c_mktsegment",
]))
def check_customer(spark, sf_dir):
    a, b, (name, segment) = rewritten_customer(spark, sf_dir)
    b = stage_table(b, "rewritten")  # the checks read it several times
    key = ["c_custkey"]
    found = [C.check_schema(a, b), C.check_volume(a, b, "customer"), C.check_completeness(a, b, key, name), C.check_consistency([(a, b, key, name)], "full_name"), C.check_fixed_points(a, b, key, segment), C.check_plausibility(b, name), *C.check_diversity(a, b, [name, segment])]
    return spark.createDataFrame([(c.requirement, c.name, c.passed, c.detail) for c in found], "requirement string, name string, passed boolean, detail string")


@query("SELECT count(*) AS n FROM customer WHERE c_custkey % 10 = 0")
def check_survivors(spark, sf_dir):
    a = table(spark, sf_dir, "customer")
    b = a.withColumn("c_name", F.when(F.col("c_custkey") % 10 == 0, F.concat("c_name", F.lit("  "))).otherwise(F.concat(F.lit("x"), "c_name")))
    return spark.createDataFrame([(C.survivors(a, b, ["c_custkey"], "c_name"),)], "n long")


@query("SELECT count(DISTINCT l_returnflag) AS n FROM lineitem")
def check_surviving_values(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").select("l_returnflag")
    return spark.createDataFrame([(C.surviving_values(a, a, "l_returnflag"),)], "n long")


@query("SELECT count(*) AS n FROM conversations c WHERE contains(c.text, 'tion the ') OR EXISTS (SELECT 1 FROM documents d WHERE length(d.text) >= 6 AND contains(c.text, d.text))")
def check_containment(spark, sf_dir):
    some = spark.createDataFrame([("tion the ",), ("short",)], "needle string").unionAll(table(spark, sf_dir, "documents").where(F.length("text") >= C.NEEDLE).select(F.col("text").alias("needle"))).distinct()
    return spark.createDataFrame([(C.containing(table(spark, sf_dir, "conversations"), "text", some),)], "n long")


@query("SELECT count(*) AS n FROM conversations WHERE contains(text, 'tion the ')")
def check_containment_joined(spark, sf_dir):
    some = spark.createDataFrame([("tion the ",), ("short",)], "needle string")
    return spark.createDataFrame([(C.containing(table(spark, sf_dir, "conversations"), "text", some, most=0),)], "n long")


def _held_by(of: str, needles: str) -> str:
    """SQL: how many rows of a table hold a needle, how many needles stand in one; (table.text column), SELECT of needles."""
    name, text = of.split(".")
    return f"SELECT '{name}' AS table_name, (SELECT count(*) FROM {name} t WHERE EXISTS (SELECT 1 FROM ({needles}) n WHERE contains(t.{text}, n.needle))) AS holding, (SELECT count(*) FROM ({needles}) n WHERE EXISTS (SELECT 1 FROM {name} t WHERE contains(t.{text}, n.needle))) AS found"


PLACES = ["conversations.text", "pages.html"]
WHOLE = "SELECT DISTINCT text AS needle FROM documents WHERE strlen(text) >= 6"
LINES = "SELECT DISTINCT needle FROM (SELECT unnest(string_split(text, chr(10))) AS needle FROM documents UNION ALL SELECT substr(text, 5, 24) FROM conversations) WHERE strlen(needle) >= 6"


def _lines(spark, sf_dir) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n", -1)).alias("needle"))
    return lines.unionAll(table(spark, sf_dir, "conversations").select(F.substring("text", 5, 24).alias("needle"))).where("octet_length(needle) >= 6").distinct()


def _contained(spark, sf_dir, needles: DataFrame) -> DataFrame:
    parts, sought = [], prepared(needles)
    for of in PLACES:
        name, text = of.split(".")
        texts = table(spark, sf_dir, name).select(text)
        found = matches(texts, text, sought)
        pairs = stage_table(found, "matches")
        marks = texts.select(mark_of(texts, text).alias("mark"))  # texts themselves need not be shuffled
        rows = marks.join(pairs.select("mark").distinct(), "mark", "left_semi").agg(F.count("*").alias("holding"))
        parts.append(rows.select(F.lit(name).alias("table_name"), "holding").join(pairs.agg(F.count_distinct("id").alias("found")), how="full"))
    return parts[0].unionAll(parts[1])


@query(" UNION ALL ".join(_held_by(of, WHOLE) for of in PLACES))
def containment_documents(spark, sf_dir):
    """All documents as needles, in conversations and pages, by the indexed join."""
    return _contained(spark, sf_dir, table(spark, sf_dir, "documents").select(F.col("text").alias("needle")))


@query(" UNION ALL ".join(_held_by(of, LINES) for of in PLACES))
def containment_lines(spark, sf_dir):
    """All lines of documents, and a stretch of each conversation, in conversations and pages."""
    return _contained(spark, sf_dir, _lines(spark, sf_dir))


@query("SELECT 'conversations' AS table_name, count(*) AS texts, true AS few, true AS spread FROM conversations UNION ALL SELECT 'pages', count(*), true, true FROM pages")
def containment_candidates(spark, sf_dir):
    """That the index proposes fewer than two places a text for all documents, and no gram over a hundredth of them
    (or two hundred)."""
    parts, (needles, own) = [], prepared(table(spark, sf_dir, "documents"), "text")
    for of in PLACES:
        name, text = of.split(".")
        texts = table(spark, sf_dir, name).select(text)
        maybe = candidates(texts.select(mark_of(texts, text).alias("mark"), F.col(text).cast("binary").alias("raw")), needles, own=own)
        each = maybe.groupBy("key").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.max("n"), F.lit(0)).alias("most"))
        rows = texts.agg(F.count("*").alias("texts")).join(each, how="full")
        parts.append(rows.select(F.lit(name).alias("table_name"), "texts", (F.col("n") < 2 * F.col("texts")).alias("few"), (F.col("most") <= F.greatest(F.lit(200), F.col("n") / 100)).alias("spread")))
    return parts[0].unionAll(parts[1])


@query("SELECT CAST(o_custkey AS VARCHAR) AS \"key\", count(DISTINCT o_orderpriority) AS replacements FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) > 1")
def check_conflicts(spark, sf_dir):
    return C.conflicts(table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("key"), F.col("o_orderpriority").alias("after")))


@query("SELECT count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 > 0)")
def check_fk_orphans(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_custkey % 5 > 0")
    return spark.createDataFrame([(C.orphans(table(spark, sf_dir, "orders"), "o_custkey", c, "c_custkey"),)], "n long")


@query("SELECT count(*) FILTER (c_custkey % 4 = 0) AS n FROM customer")
def check_implausible(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 4 == 0, "no mail").otherwise(F.concat("c_custkey", F.lit("@x.example"))).alias("mail"))
    return spark.createDataFrame([(C.implausible(c, "mail", "email"),)], "n long")


# ---------------------------------------------------------------- control data


def _requests(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("id"), F.concat(F.lit("run-"), k).alias("run_id"), F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "failed").otherwise("queued").alias("status"), (F.col("o_orderstatus") == "F").alias("publishable"))


@query("SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'failed' ELSE 'queued' END AS status FROM orders ORDER BY o_orderkey DESC LIMIT 100")
def latest_requests(spark, sf_dir):
    return control.latest(_requests(spark, sf_dir), 100).select("id", "status")


@query("SELECT min(o_orderkey) AS id FROM orders WHERE o_orderstatus NOT IN ('F', 'P')")
def next_request(spark, sf_dir):
    return control.next_queued(_requests(spark, sf_dir)).select("id")


@query("SELECT c_custkey AS id, c_custkey % 5 > 0 AND c_custkey % 300 <= 120 AS ready FROM customer")
def ready_resources(spark, sf_dir):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k.alias("id"), (k % 5 > 0).alias("enabled"), F.timestamp_seconds(F.unix_seconds(now) - k % 300).alias("available_at"))
    return control.ready(rows, now).select("id", "ready")


@query("SELECT o_orderkey AS request_id, 'c' || o_custkey AS recipient, 'run-' || o_orderkey AS run_id FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 3 > 0")
def active_grants(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    grants = o.select(F.col("o_orderkey").alias("request_id"), F.concat(F.lit("c"), "o_custkey").alias("recipient"), F.when(F.col("o_custkey") % 3 == 0, F.lit("2024-01-01")).cast("timestamp").alias("revoked_at"))
    return control.active_grants(grants, _requests(spark, sf_dir)).select("request_id", "recipient", "run_id")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and segments of customers replaced, and the checks of the result."""
    return check_customer(spark, sf_dir)


from palimpsest import queries_plans, queries_tables, queries_text  # noqa: E402, F401  (registers their queries)
