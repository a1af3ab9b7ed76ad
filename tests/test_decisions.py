import json

from pyspark.sql import functions as F

from arborlake.operators import decisions as D
from arborlake.operators import graph as G
from arborlake.operators import lineage as L
from arborlake.operators import tree as R


def test_operations_see_what_earlier_ones_left(spark):
    nodes = [("ROOT", None), ("A", "ROOT"), ("B", "ROOT"), ("a1", "A"), ("a2", "A"), ("a3", "a1"), ("a4", "a2"), ("b1", "B")]
    tree = spark.createDataFrame([(n, n, "L", p, 0) for n, p in nodes], "node_id string, label string, level string, parent_id string, ord long")
    ops = [
        (1, "move", "a3", "a2", None), (2, "move", "a2", "a3", None), (3, "merge", "a1", "a2", None), (4, "rename", "a1", None, "x"), (5, "move", "a4", "a1", None), (6, "rename", "a2", None, "new"),
        (7, "merge", "a3", "b1", None), (8, "merge", "a4", "a4", None), (9, "split", "a4", "a2", None), (10, "rename", "b1", None, None), (11, "move", "zz", "a2", None), (12, "move", "a3", "A", None), (13, "merge", "a2", "a3", None),
    ]
    kept, log = L.apply_operations(tree, R.tree_table(tree), spark.createDataFrame(ops, "seq int, type string, node_id string, target string, label string"))
    got = {r.seq: r.message for r in log.collect()}
    assert got == {1: "ok", 2: "below itself", 3: "ok", 4: "unknown node", 5: "unknown target", 6: "ok", 7: "other branch", 8: "same node", 9: "unknown type", 10: "no label", 11: "unknown node", 12: "ok", 13: "ok"}
    assert {r.node_id: (r.parent_id, r.label) for r in kept.collect()} == {"ROOT": (None, "ROOT"), "A": ("ROOT", "A"), "B": ("ROOT", "B"), "a3": ("A", "a3"), "a4": ("a3", "a4"), "b1": ("B", "b1")}
    none = spark.createDataFrame([], "seq int, type string, node_id string, target string, label string")
    assert L.apply_operations(tree, R.tree_table(tree), none)[0].count() == 8


def test_rerank_layouts(spark):
    cases = [
        ({"results": [{"index": 1, "relevance_score": 0.5}, {"index": 7, "score": 1}, {"index": 1, "score": 0.25}]}, 3, [0.0, 0.25, 0.0]),
        ({"output": {"results": [{"index": 0, "score": 0.5}]}}, 1, [0.5]), ({"data": [0.5, "0.25"]}, 3, [0.5, 0.25, 0.0]), ({"data": [["d", 0.5], {"score": 0.75}, None]}, 2, [0.5, 0.75]), ({"results": []}, 2, [0.0, 0.0]),
        ("bad", 2, None), (None, 2, None), ({"results": [{"score": "x"}]}, 1, [0.0]), ({"results": [1]}, 0, []),
    ]
    df = spark.createDataFrame([(i, c if isinstance(c, str) or c is None else json.dumps(c), n) for i, (c, n, _) in enumerate(cases)], "i int, r string, n int")
    assert {r.i: r.s for r in df.select("i", D.rerank_scores(F.col("r"), F.col("n")).alias("s")).collect()} == {i: w for i, (_, _, w) in enumerate(cases)}


def test_requests_split_busy_ids(spark):
    pairs = spark.createDataFrame([("hub", f"x{i:03}") for i in range(45)] * 2 + [("a", "b")], "id_a string, id_b string")
    req = {(r.id_a, r.chunk): r.documents for r in D.rerank_requests(pairs).collect()}
    assert {k: len(v) for k, v in req.items()} == {("hub", 0): 20, ("hub", 1): 20, ("hub", 2): 5, ("a", 0): 1} and req["hub", 1][0] == "x020"
    res = D.rerank_results(D.rerank_requests(pairs), spark.createDataFrame([("hub", 2, '{"data": [0.5]}')], "id_a string, chunk int, response string"))
    got = {(r.id_a, r.id_b): r.rerank_score for r in res.collect()}
    assert len(got) == 46 and got["hub", "x040"] == 0.5 and got["hub", "x041"] == 0.0 and got["hub", "x000"] is None
    assert D.rerank_requests(pairs.limit(0)).count() == 0


def test_linking_rounds(spark):
    members = spark.createDataFrame([(1, "A")] * 3 + [(2, None)] * 2 + [(3, None), (4, "B"), (4, None), (4, None), (5, None), (6, None)], "node_id int, l1 string")
    labels = spark.createDataFrame([(2, "roads"), (3, "old fields"), (4, "x"), (5, "air old"), (6, "y")], "node_id int, label string")
    tops = spark.createDataFrame([("A", "air"), ("B", "boats")], "id string, label string")
    fast = spark.createDataFrame([(2, "B", 0.9, False), (3, "zz", 0.99, None), (6, None, None, None)], "node_id int, best_id string, confidence double, create_new boolean")
    audit = spark.createDataFrame([(3, None, None, True, " fields "), (4, None, 0.0, True, "fields"), (6, "nope", 0.7, False, None)], "node_id int, best_id string, confidence double, create_new boolean, new_label string")
    links, new = G.vote_link(members, labels, tops, 0.5, fast, audit)
    (cat,) = new.collect()
    assert (cat.label, cat.size) == ("fields", 1)
    got = {r.node_id: (r.parent_id, r.decision, r.is_new_parent) for r in links.collect()}
    assert got == {1: ("A", "R1_Hard_Link", False), 2: ("B", "R2_Fast_Match", False), 3: (cat.node_id, "R3_New_Created", True), 4: (cat.node_id, "R3_Deep_Audit", False), 5: ("A", "R3_Deep_Audit", False), 6: ("A", "R3_Deep_Audit", False)}
    assert {r.decision for r in G.vote_link(members, labels, tops)[0].collect()} == {"R1_Hard_Link", "R3_Deep_Audit"}


def test_created_parents_are_candidates_of_later_children(spark):
    import random

    rng = random.Random(4)
    kids = [(f"k{i:02}", rng.choice("xyz"), float(rng.randint(0, 60))) for i in range(60)]
    parents = [(f"p{i}", rng.choice("xy"), float(rng.randint(0, 60))) for i in range(5)]
    wishes, picks = {f"k{i:02}" for i in range(0, 60, 3)}, {"k01": "p0", "k02": "p1"}
    rate = lambda a, b: 1 - abs(a - b) / 100
    want, made = {}, []
    for k, g, x in sorted(kids):
        cand = sorted([(-round(rate(x, y), 9), p) for p, h, y in parents + made if h == g])[:5]
        new = "NEW_" + __import__("hashlib").md5(k.encode()).hexdigest()[:8]
        if cand and -cand[0][0] >= 0.95:
            want[k] = (cand[0][1], "hard_assign")
        elif not cand or k in wishes:
            want[k] = (new, "model_create" if cand else "create")
            made.append((new, g, x))
        elif picks.get(k) in {p for _, p in cand}:
            want[k] = (picks[k], "model_assign")
        else:
            want[k] = (cand[0][1], "fallback_top1")
    c = spark.createDataFrame(kids, "node_id string, l1 string, a double")
    p = spark.createDataFrame(parents, "node_id string, l1 string, b double")
    rows = [(k, None, 0.5, True) for k in wishes] + [(k, v, 0.9, False) for k, v in picks.items()]
    out = G.assign_parents(c, p, 1 - F.abs(F.col("c_a") - F.col("p_b")) / 100, spark.createDataFrame(rows, "child_id string, parent_id string, confidence double, create boolean"), hard=0.95, as_parent={"a": "b"})
    assert {r.child_id: (r.parent_id, r.decision) for r in out.collect()} == want
    assert G.assign_parents(c.limit(0), p, 1 - F.abs(F.col("c_a") - F.col("p_b")) / 100, as_parent={"a": "b"}).count() == 0
