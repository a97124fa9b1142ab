"""What goes when parents go: the rows that lose a parent, and those that lose them in turn.

A foreign key may have several columns, refer to its own table, or lie on a cycle of tables. Only keys of
lost rows are carried from round to round, and only the new ones: a round joins each table that refers to
one of them once. On tables without cycles there are as many rounds as the longest chain of foreign keys
at most; a cycle goes on as long as it finds rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.plans.storage import stage_table


@dataclass(frozen=True)
class ForeignKey:
    """``columns`` of ``child`` refer to ``key`` of ``parent``, in this order."""

    child: str
    columns: tuple[str, ...]
    parent: str
    key: tuple[str, ...]

    def __post_init__(self) -> None:
        if not self.columns or len(self.columns) != len(self.key):
            raise ValueError(f"{self.child} {self.columns} cannot refer to {self.parent} {self.key}")


def load_order(tables: list[str], keys: list[ForeignKey]) -> list[list[str]]:
    """Groups of tables in an order in which each comes after all it refers to; tables on a cycle are one group,
    whose keys have to be checked after all of them."""
    parents = {t: sorted({k.parent for k in keys if k.child == t and k.parent in tables}) for t in tables}
    reach = {t: {t} for t in tables}
    changed = True
    while changed:  # a schema's graph, not its data
        changed = False
        for t in tables:
            more = set().union(*(reach[p] for p in parents[t])) - reach[t]
            reach[t] |= more
            changed |= bool(more)
    groups = {frozenset(o for o in tables if o in reach[t] and t in reach[o]) for t in tables}
    return [sorted(g) for g in sorted(groups, key=lambda g: (len(reach[min(g)]), min(g)))]


def _values(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Different keys as ``k0``, ``k1``, ...; one with a null refers to nothing."""
    at = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(columns)]
    return df.select(*at).dropna().distinct()


def _meet(df: DataFrame, columns: tuple[str, ...], other: DataFrame, how: str, nulls: bool = False) -> DataFrame:
    """A semi or anti join of columns with those of another table, in order; names of the two may clash."""
    pairs = [(F.col(f"own.`{c}`"), F.col(f"other.`{o}`")) for c, o in zip(columns, other.columns, strict=True)]
    return df.alias("own").join(other.alias("other"), [a.eqNullSafe(b) if nulls else a == b for a, b in pairs], how)


@dataclass
class Losses:
    """Lost keys by parent and its columns, and how many rounds it took to find them."""

    tables: dict[str, DataFrame]
    keys: list[ForeignKey]
    removed: dict[str, DataFrame]
    lost: dict[tuple[str, tuple[str, ...]], DataFrame]
    rounds: int

    def rows(self, table: str) -> DataFrame:
        """The rows of a table that lose a parent, or are among those removed; repeated rows are as often there."""
        df, marks = self.tables[table], []
        out = df.select(F.struct("*").alias("row"), *[F.col(f"`{c}`").alias(f"c{n}_{i}") for n, k in enumerate(self._own(table)) for i, c in enumerate(k.columns)])
        for n, k in enumerate(self._own(table)):
            held = self.lost[k.parent, k.key].withColumn("gone", F.lit(True)).withColumnsRenamed({f"k{i}": f"l{n}_{i}" for i in range(len(k.key))} | {"gone": f"gone{n}"})
            out = out.join(held, [F.col(f"c{n}_{i}") == F.col(f"l{n}_{i}") for i in range(len(k.key))], "left")
            marks.append(F.col(f"gone{n}"))
        if table in self.removed:
            names = self.removed[table].columns
            gone = self.removed[table].distinct().select(*[F.col(f"`{c}`").alias(f"g{i}") for i, c in enumerate(names)], F.lit(True).alias("removed"))
            out = out.join(gone, [F.col(f"row.`{c}`").eqNullSafe(F.col(f"g{i}")) for i, c in enumerate(names)], "left")
            marks.append(F.col("removed"))
        return out.where(F.coalesce(*marks, F.lit(False))).select("row.*")

    def kept(self, table: str) -> DataFrame:
        """The rows that stay; a table that refers to nothing lost stays whole."""
        df = self.tables[table]
        for k in self._own(table):
            df = _meet(df, k.columns, self.lost[k.parent, k.key], "left_anti")
        if table in self.removed:
            df = _meet(df, tuple(self.removed[table].columns), self.removed[table], "left_anti", nulls=True)
        return df

    def _own(self, table: str) -> list[ForeignKey]:
        return [k for k in self.keys if k.child == table and (k.parent, k.key) in self.lost]


def losses(tables: dict[str, DataFrame], keys: list[ForeignKey], removed: dict[str, DataFrame]) -> Losses:
    """All that goes with the rows ``removed`` (by table: some of its columns, which tell the rows that go).

    A foreign key with a null refers to nothing. Rows that never had a parent are not lost: ``checks.orphans``
    finds them.
    """
    for k in keys:
        for t, columns in ((k.child, k.columns), (k.parent, k.key)):
            if t not in tables or set(columns) - set(tables[t].columns):
                raise ValueError(f"no table {t} with columns {', '.join(columns)}")
    sought = {(k.parent, k.key) for k in keys}
    lost: dict[tuple[str, tuple[str, ...]], DataFrame] = {}

    def add(found: dict[tuple[str, tuple[str, ...]], DataFrame]) -> dict[tuple[str, tuple[str, ...]], DataFrame]:
        """The keys that are new, which from now on are lost."""
        new = {}
        for at, values in found.items():
            names = values.columns
            fresh = stage_table(values.join(lost[at], names, "left_anti") if at in lost else values, "lost-keys")
            if not fresh.isEmpty():
                new[at] = fresh
                lost[at] = lost[at].unionByName(fresh) if at in lost else fresh
        return new

    first = {}
    for parent, columns in sought:
        if parent in removed:
            rows = _meet(tables[parent], tuple(removed[parent].columns), removed[parent], "left_semi", nulls=True)
            first[parent, columns] = _values(rows, columns)
    new, rounds = add(first), 0
    while new:
        rounds += 1
        found: dict[tuple[str, tuple[str, ...]], DataFrame] = {}
        for k in keys:
            if (k.parent, k.key) not in new:
                continue
            for parent, columns in sought:
                if parent == k.child:
                    values = _values(_meet(tables[k.child], k.columns, new[k.parent, k.key], "left_semi"), columns)
                    found[parent, columns] = found[parent, columns].unionByName(values).distinct() if (parent, columns) in found else values
        new = add(found)
    return Losses(tables, keys, removed, lost, rounds)
