"""Rows that go with their parents, against loops over all rows."""

import random

import pytest

from palimpsest.operators.closure import ForeignKey, load_order, losses


def brute(rows, keys, removed):
    lost = {t: {i for i, r in enumerate(rs) if removed.get(t, lambda r: False)(r)} for t, rs in rows.items()}
    changed = True
    while changed:
        changed = False
        for k in keys:
            gone = {tuple(rows[k.parent][i][c] for c in k.key) for i in lost[k.parent]}
            for i, r in enumerate(rows[k.child]):
                value = tuple(r[c] for c in k.columns)
                if i not in lost[k.child] and None not in value and value in gone:
                    lost[k.child].add(i)
                    changed = True
    return lost


def test_load_order():
    f = lambda a, b: ForeignKey(a, ("x",), b, ("id",))
    keys = [f("orders", "clients"), f("items", "orders"), f("a", "b"), f("b", "c"), f("c", "a"), f("c", "clients"), f("d", "b"), f("e", "e")]
    assert load_order(["items", "orders", "clients", "a", "b", "c", "d", "e"], keys) == [["clients"], ["e"], ["orders"], ["items"], ["a", "b", "c"], ["d"]]
    with pytest.raises(ValueError, match="cannot refer"):
        ForeignKey("a", ("x", "y"), "b", ("id",))


def test_cycles_composite_keys_and_nulls(spark):
    random.seed(6)
    some = lambda n: random.choice([None, *range(n)])
    rows = {
        "staff": [{"id": i, "boss": i - 1 if i % 9 else None, "office": some(12), "row": "x"} for i in range(60)],
        "offices": [{"id": i, "head": some(60), "row": "x"} for i in range(12)],
        "rooms": [{"office": o, "room": r, "k0": 1} for o in range(12) for r in range(3)],
        "desks": [{"office": some(12), "room": some(4), "owner": some(60)} for _ in range(80)] * 2,
        "pens": [{"name": None, "n": i % 3} for i in range(9)],
    }
    keys = [
        ForeignKey("staff", ("boss",), "staff", ("id",)), ForeignKey("staff", ("office",), "offices", ("id",)), ForeignKey("offices", ("head",), "staff", ("id",)),
        ForeignKey("rooms", ("office",), "offices", ("id",)), ForeignKey("desks", ("office", "room"), "rooms", ("office", "room")), ForeignKey("desks", ("owner",), "staff", ("id",)),
    ]
    kinds = {"staff": "id int, boss int, office int, row string", "offices": "id int, head int, row string", "rooms": "office int, room int, k0 int", "desks": "office int, room int, owner int", "pens": "name string, n int"}
    tables = {t: spark.createDataFrame([tuple(r.values()) for r in rs], kinds[t]) for t, rs in rows.items()}
    for tests in ({"staff": lambda r: r["id"] == 40}, {"offices": lambda r: r["id"] in (2, 3), "desks": lambda r: r["owner"] is None}, {"rooms": lambda r: r["room"] == 1}, {}):
        removed = {t: spark.createDataFrame([tuple(r.values()) for r in rows[t] if f(r)], kinds[t]) for t, f in tests.items()}
        found, want = losses(tables, keys, removed), brute(rows, keys, tests)
        for t, rs in rows.items():
            text = lambda r: str(tuple(r))
            assert sorted(map(text, found.rows(t).collect())) == sorted(text(rs[i].values()) for i in want[t]), t
            assert sorted(map(text, found.kept(t).collect())) == sorted(text(r.values()) for i, r in enumerate(rs) if i not in want[t]), t
    with pytest.raises(ValueError, match="no table"):
        losses(tables, [ForeignKey("staff", ("nothing",), "offices", ("id",))], {})


def test_rounds_follow_the_chain(spark):
    tables = {f"t{k}": spark.range(200).selectExpr("id", "id as up") for k in range(5)}
    keys = [ForeignKey(f"t{k + 1}", ("up",), f"t{k}", ("id",)) for k in range(4)]
    found = losses(tables, keys, {"t0": spark.range(10).toDF("id")})
    assert found.rounds <= 4 and [found.rows(t).count() for t in tables] == [10] * 5 and found.kept("t4").count() == 190
