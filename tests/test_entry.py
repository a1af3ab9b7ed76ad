import importlib
import json
import os

import pytest

import __spark_entry__ as entry
from arborlake.operators.reshape import keep_last  # noqa: F401
from arborlake.sources import tables as S
from arborlake.streaming.upserts import stream_counts, stream_upsert

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_registry():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 150


def test_core_does_not_need_the_optional_subpackage():
    for folder, _, files in os.walk(os.path.dirname(importlib.import_module("arborlake").__file__)):
        if os.path.basename(folder) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                with open(os.path.join(folder, f), encoding="utf-8") as g:
                    assert "arborlake.llm" not in g.read()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_flagship(spark):
    assert entry.entry(spark).columns == ["node_id", "root_id", "depth"]


def test_trees_and_files(spark, tmp_path):
    tree = {"node_id": "ROOT", "label": "", "level": "ROOT", "children": [{"node_id": " a ", "label": "x/y", "level": "L1", "children": []}]}
    path = tmp_path / "tree.json"
    path.write_text(json.dumps(tree))
    rows = [tuple(r) for r in S.load_tree(spark, str(path)).collect()]
    assert S.nested_tree(rows)["children"][0]["label"] == "x/y"
    csv = tmp_path / "a.csv"
    csv.write_text('﻿id,text\n1,NA\n2,"two\nlines"\n3,\n', encoding="utf-8")
    assert [tuple(r) for r in S.read_csv(spark, str(csv)).orderBy("id").collect()] == [("1", None), ("2", "two\nlines"), ("3", None)]
    assert [tuple(r) for r in S.read_csv(spark, str(csv), False).orderBy("id").collect()] == [("1", "NA"), ("2", "two\nlines"), ("3", "")]
    empty = tmp_path / "empty.csv"
    empty.write_text("id,text\n")
    assert S.read_csv(spark, str(empty)).count() == 0
    log = tmp_path / "log.jsonl"
    log.write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    assert sorted(r.a for r in S.read_json_lines(spark, str(log), "a int").collect()) == [1, 2]
    with pytest.raises(FileNotFoundError):
        S.first_existing(str(tmp_path / "no"))


def test_streams(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").coalesce(1).write.parquet(src)
    schema = "k int, v string"
    args = (str(tmp_path / "table"), ["k"], str(tmp_path / "check"))
    stream_upsert(spark.readStream.schema(schema).parquet(src), *args).awaitTermination()
    spark.createDataFrame([(2, "c"), (3, "d")], schema).coalesce(1).write.mode("append").parquet(src)
    stream_upsert(spark.readStream.schema(schema).parquet(src), *args).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(f"{args[0]}/v1").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    events = spark.readStream.format("rate").load().selectExpr("timestamp", "cast(value % 2 as string) k")
    assert stream_counts(events, "timestamp", "k").isStreaming


def test_places(tmp_path):
    c = S.Catalog(str(tmp_path) + "/")
    assert c.nodes("L3").endswith("/tree_nodes_L3") and c.links("L4", "L3").endswith("/tree_parent_links_L4_to_L3")
    for name in ("a.json", "label_map.json", "b.txt"):
        (tmp_path / name).write_text("{}")
    assert c.trees() == [f"{tmp_path}/a.json"]


def test_decision_settings():
    from arborlake.operators import decisions as D

    p = D.Profile(retries=4)
    assert D.retry_delays(p, [500, 429, 503, 500]) == [1.0, 1.5, 2.25] and D.retry_delays(p, [400, 500]) == []
    assert p.resolve({}, {"DECISION_RETRIES": "2"}).retries == 2 and p.resolve({"model": "m"}, {"DECISION_MODEL": "n"}).model == "m"
