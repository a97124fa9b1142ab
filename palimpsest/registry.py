"""What registered queries share: the registry, the tables, a secret for tests, and SQL for its keyed functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest.functions import prf
from palimpsest.functions.index_stream import GAMMA, MIX_1, MIX_2
from palimpsest.functions.validators import INN_10, INN_11, INN_12
from palimpsest.plans.rulepack import default_pack

KEY = b"0123456789abcdef0123456789abcdef"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def secret() -> prf.Secret:
    return prf.Secret(KEY)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None, name: str | None = None):
    """Registers a function as a query, with its SQL if there is any."""

    def put(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return put


IPAD = bytes(b ^ 0x36 for b in KEY.ljust(64, b"\0")).hex()
OPAD = bytes(b ^ 0x5C for b in KEY.ljust(64, b"\0")).hex()


def sql_hmac(blob: str) -> str:
    return f"sha256(unhex('{OPAD}') || unhex(sha256(unhex('{IPAD}') || {blob})))"


def sql_key(value: str, label: str = "''") -> str:
    return f"(unhex(printf('%08x', strlen({value}))) || unhex(printf('%08x', strlen({label}))) || encode({value}) || encode({label}))"


def sql_index(value: str, label: str = "''") -> str:
    """The unsigned index of a key, wide enough to be added to."""
    return f"CAST(CAST('0x' || substr({sql_hmac(sql_key(value, label))}, 1, 16) AS UBIGINT) AS UHUGEINT)"


def u64(expression: str) -> str:
    return f"(({expression}) % 18446744073709551616::UHUGEINT)"


def splitmix(state: str) -> str:
    """The value of a SplitMix64 state in UHUGEINT arithmetic (products split in halves to stay in 128 bits)."""
    z = state
    for shift, factor in ((30, MIX_1), (27, MIX_2)):
        x = f"xor(CAST({z} AS UBIGINT), CAST({z} AS UBIGINT) >> {shift})"
        z = u64(f"{x}::UHUGEINT * {factor}::UHUGEINT")
    return f"xor(CAST({z} AS UBIGINT), CAST({z} AS UBIGINT) >> 31)"


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def digit_sum(text: str, weights: tuple[int, ...]) -> str:
    return " + ".join(f"CAST(substr({text}, {i + 1}, 1) AS INT) * {w}" for i, w in enumerate(weights))


PACK = default_pack()


def _pick(component: str, draw: int) -> str:
    values = PACK.components[component]
    return f"{sql_list(values)}[CAST(d{draw} % {len(values)} AS BIGINT) + 1]"


def _digits(first: int, count: int) -> str:
    return " || ".join(f"CAST(d{k} % 10 AS VARCHAR)" for k in range(first, first + count))


def _stages(semantic_type: str) -> tuple[int, list[str]]:
    """How many numbers a type's value draws, and expressions one after the other; the last one names ``value``."""
    if semantic_type in PACK.templates:
        variants, deepest, cases = PACK.templates[semantic_type], 1, []
        for k, template in enumerate(variants):
            draw, pieces = 1, []
            for is_component, text in template.parts:
                draw += is_component
                pieces.append(_pick(text, draw) if is_component else sql_list([text])[1:-1])
            deepest = max(deepest, draw)
            cases.append(f"WHEN d1 % {len(variants)} = {k} THEN {' || '.join(pieces)}")
        return deepest, [f"CASE {' '.join(cases)} END AS value"]
    return {
        "inn_person": (9, [f"{_pick('inn_region', 1)} || {_digits(2, 8)} AS body", f"body || CAST(({digit_sum('body', INN_11)}) % 11 % 10 AS VARCHAR) AS more", f"more || CAST(({digit_sum('more', INN_12)}) % 11 % 10 AS VARCHAR) AS value"]),
        "inn_legal": (8, [f"{_pick('inn_region', 1)} || {_digits(2, 7)} AS body", f"body || CAST(({digit_sum('body', INN_10)}) % 11 % 10 AS VARCHAR) AS value"]),
        "snils": (9, [
            f"{_digits(1, 9)} AS body", f"{digit_sum('body', tuple(range(9, 0, -1)))} AS total",
            "substr(body, 1, 3) || '-' || substr(body, 4, 3) || '-' || substr(body, 7, 3) || ' ' || lpad(CAST(CASE WHEN total < 100 THEN total WHEN total <= 101 THEN 0 ELSE total % 101 % 100 END AS VARCHAR), 2, '0') AS value",
        ]),
        "phone": (8, [f"'+7' || {_pick('phone_operator', 1)} || {_digits(2, 7)} AS value"]),
        "passport": (7, [f"{_pick('passport_series', 1)} || ' ' || {_digits(2, 6)} AS value"]),
        "birth_date": (3, [
            f"make_date(CAST({_pick('birth_year', 1)} AS BIGINT), CAST(1 + d2 % 12 AS BIGINT), 1) AS month",
            "CAST(month + CAST(d3 % CAST(day(last_day(month)) AS UBIGINT) AS INT) AS VARCHAR) AS value",
        ]),
    }[semantic_type]


def sql_rendered(source: str, semantic_type: str) -> str:
    """The rows of ``source`` (a SELECT with a wide unsigned column ``idx``) and each index's ``value``.

    Numbers are taken without the bias test, which sends back less than one draw in 10^17.
    """
    count, stages = _stages(semantic_type)
    states = ", ".join(f"{u64(f'idx + {k * GAMMA % (1 << 64)}::UHUGEINT')} AS s{k}" for k in range(1, count + 1))
    draws = ", ".join(f"{splitmix(f's{k}')} AS d{k}" for k in range(1, count + 1))
    out = f"SELECT *, {draws} FROM (SELECT *, {states} FROM ({source}))"
    for stage in stages:
        out = f"SELECT *, {stage} FROM ({out})"
    return out


def sql_keys(of: str, column: str) -> str:
    """``key`` and ``idx`` of a column's different values in the canonical form of texts."""
    return f"SELECT key, {sql_index('key')} AS idx FROM (SELECT DISTINCT rtrim({column}, ' ') AS key FROM {of} WHERE rtrim({column}, ' ') <> '')"


def sql_bijection(keys: str, semantic_type: str) -> str:
    """``key`` and ``replacement``: rounds of candidates, each held by the smallest key that wants it."""
    def candidate(rows: str) -> str:
        return f"SELECT key, idx0, probe, round, value FROM ({sql_rendered(rows, semantic_type)})"

    first = candidate(f"SELECT key, idx AS idx0, 0 AS probe, 0 AS round, idx FROM ({keys})")
    judged = "SELECT *, coalesce(value = key OR key <> min(CASE WHEN value <> key THEN key END) OVER (PARTITION BY value), true) AS lost FROM rounds"
    again = candidate(f"SELECT key, idx0, probe, round, {u64('idx0 + CAST(probe AS UHUGEINT)')} AS idx FROM (SELECT key, idx0, probe + CAST(lost AS INT) AS probe, round + 1 AS round FROM (SELECT *, bool_or(lost) OVER () AS any_lost FROM ({judged})) WHERE any_lost)")
    return f"WITH RECURSIVE rounds AS ({first} UNION ALL {again}) SELECT key, value AS replacement FROM rounds WHERE round = (SELECT max(round) FROM rounds)"


def sql_derangement(values: str, semantic_type: str) -> str:
    """``key`` and ``replacement`` of a cyclic shuffle of the column ``v`` of ``values``."""
    seed = sql_index(f"'{semantic_type}'")
    swap = "[CASE WHEN k = last THEN places[other + 1] WHEN k = other THEN places[last + 1] ELSE places[k + 1] END for k in range(n)]"
    drawn = f"SELECT places, n, seed, t, n - t AS last, CAST({splitmix('state')} % CAST(n - t AS UBIGINT) AS BIGINT) AS other FROM (SELECT *, {u64(f'seed + CAST(t AS UHUGEINT) * {GAMMA}::UHUGEINT')} AS state FROM (SELECT places, n, seed, t + 1 AS t FROM steps WHERE t + 1 < n))"
    return f"""WITH RECURSIVE listed AS (SELECT list(v ORDER BY v) AS vs FROM ({values})),
steps AS (SELECT range(len(vs)) AS places, CAST(len(vs) AS BIGINT) AS n, {seed} AS seed, CAST(0 AS BIGINT) AS t FROM listed
 UNION ALL SELECT {swap} AS places, n, seed, t FROM ({drawn}))
SELECT vs[k + 1] AS key, vs[places[k + 1] + 1] AS replacement FROM (SELECT vs, places, unnest(range(len(vs))) AS k FROM listed, (SELECT places FROM steps ORDER BY t DESC LIMIT 1))"""


_SPARK_TYPE = "CASE column_type WHEN 'INTEGER' THEN 'int' WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(column_type) END"


def sql_columns(of: str) -> str:
    return f"SELECT '{of}' AS table_name, column_name, CAST(row_number() OVER () AS INT) AS ordinal, {_SPARK_TYPE} AS data_type, \"null\" = 'YES' AS nullable FROM (DESCRIBE {of})"
