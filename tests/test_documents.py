"""Texts of documents taken apart in the JVM, against the plain walk of Python."""

import json
import random

import pytest

from palimpsest.operators import document
from palimpsest.operators.document import document_leaves, leaves, load, rewrite_documents


def made_up(n, depth):
    kind = random.random()
    if depth == 0 or kind < 0.3:
        return random.choice(["text", "a \"quote\" {[", "ünï \\ back", " ", "", "\n", 3, 2.5, None, True, "]}"])
    if kind < 0.65:
        return [made_up(n, depth - 1) for _ in range(random.randint(0, n))]
    return {random.choice(["a", "b.c", "d", "", "é"]) + str(k): made_up(n, depth - 1) for k in range(random.randint(0, n))}


DOCS = ['"root"', "null", "3", "[]", "{}", '[[["deep"]]]', '{"a": 1, "a": "twice"}', "  ", "", None, '{"x": {"y": ["p", {"z": "q"}, null, []]}}', "[" * 30 + '"very deep"' + "]" * 30, json.dumps({"long": "x" * 70_000, "k": ["v"]})]


@pytest.mark.parametrize("wide", [document.WIDE, 40])
def test_equals_the_plain_walk(spark, monkeypatch, wide):
    monkeypatch.setattr(document, "WIDE", wide)
    random.seed(12)
    docs = DOCS + [json.dumps(made_up(4, random.randint(0, 5)), ensure_ascii=random.random() < 0.5) for _ in range(150)]
    df = spark.createDataFrame([(d, "p") for d in docs], "doc string, path string")
    want = sorted(leaf for d in docs if d and d.strip() for leaf in leaves(load(d)))
    assert sorted(map(tuple, document_leaves(df, "doc").collect())) == want and len(want) > 150
    assert document_leaves(df.where("false"), "doc").count() == 0


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([('{"a": ["b", {"c": "d"}]}',)] * 3, "doc string")
    plan = document.path_summary(df, "doc")._jdf.queryExecution().executedPlan().toString()
    assert "Generate variant_explode" in plan and "Pandas" not in plan and "Python" not in plan


def test_no_json_fails(spark):
    with pytest.raises(Exception, match="JSONDecodeError"):
        document_leaves(spark.createDataFrame([("{no json",)], "doc string"), "doc").collect()


def test_a_batch_in_one_file_is_spread(spark, tmp_path):
    """A file that cannot be split is taken apart behind a shuffle, equal documents once."""
    doc = '{"a": ["x", {"b": "y"}, 1.0], "c": "x"}'
    spark.createDataFrame([(k, doc if k % 3 else '["y"]') for k in range(30)], "id int, doc string").coalesce(1).write.parquet(str(tmp_path / "one"))
    df = spark.read.parquet(str(tmp_path / "one"))
    words = spark.createDataFrame([("free_text", "x", "X"), ("free_text", "y", "Y")], "type string, key string, replacement string")
    out = rewrite_documents(df, "doc", words, {})
    plan = out._jdf.queryExecution().executedPlan().toString()
    taken = plan[plan.index("MapInPandas") :]
    assert "Exchange hashpartitioning(mark" in taken[: taken.index("FileScan")]
    new = '{"a":["X",{"b":"Y"},1.0],"c":"X"}'
    assert {r["id"]: r["doc"] for r in out.collect()} == {k: new if k % 3 else '["Y"]' for k in range(30)}
