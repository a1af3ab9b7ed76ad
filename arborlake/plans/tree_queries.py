"""Tree operators, lineage and checks over ROOT > region > nation > customer and supplier."""

from pyspark.sql import functions as F

from arborlake.functions import text as T
from arborlake.operators import checks as C
from arborlake.operators import lineage as L
from arborlake.operators import tree as R
from arborlake.operators.hierarchy import newest_links
from arborlake.operators.ranking import sliding_pairs
from arborlake.plans import query
from arborlake.plans.hierarchy_queries import _CLIMB
from arborlake.runtime import Stage, table


def nodes_and_links(spark, d):
    """Every third customer of BUILDING has no label, every 7th customer its nation's; levels of every
    50th are wrong."""
    col, lit = F.col, F.lit
    reg = table(spark, d, "region").select(F.concat(lit("R"), col("r_regionkey").cast("string")).alias("node_id"), col("r_name").alias("label"), lit("L1").alias("level"), lit(None).cast("string").alias("parent_id"), col("r_regionkey").cast("long").alias("ord"))
    nat = table(spark, d, "nation").select(F.concat(lit("N"), col("n_nationkey").cast("string")), col("n_name"), lit("L2"), F.concat(lit("R"), col("n_regionkey").cast("string")), col("n_nationkey").cast("long"))
    names = table(spark, d, "nation").select(col("n_nationkey").alias("_n"), "n_name")
    cus = table(spark, d, "customer").join(names, col("c_nationkey") == col("_n")).select(
        F.concat(lit("C"), col("c_custkey").cast("string")), F.when(col("c_custkey") % 7 == 0, col("n_name")).when((col("c_mktsegment") == "BUILDING") & (col("c_custkey") % 3 == 0), "").when(col("c_custkey") % 2 == 0, col("c_mktsegment")).otherwise(col("c_name")),
        F.when(col("c_custkey") % 50 == 0, "L4").otherwise("L3"), F.concat(lit("N"), col("c_nationkey").cast("string")), col("c_custkey").cast("long"))
    sup = table(spark, d, "supplier").select(F.concat(lit("S"), col("s_suppkey").cast("string")), F.concat(lit("Supplier of goods number "), col("s_suppkey").cast("string")), lit("L3"), F.concat(lit("N"), col("s_nationkey").cast("string")), col("s_suppkey").cast("long"))
    all_ = reg.union(nat).union(cus).union(sup)
    unknown = all_.filter("level = 'L1'").select(F.concat(lit("X"), "node_id").alias("child_id"), "node_id", "ord")  # links to nothing
    links = all_.filter("parent_id is not null").select(col("node_id").alias("child_id"), "parent_id", "ord").union(unknown)
    return all_.select("node_id", "label", "level"), links, all_.select("node_id", "ord")


def tree(spark, d):
    n, l, o = nodes_and_links(spark, d)
    t = R.build_tree(n, l)
    return t.drop("ord").join(o, "node_id", "left").withColumn("ord", F.coalesce("ord", F.lit(0).cast("long")))


def full(spark, d):
    t = Stage(spark, "tree").save(tree(spark, d))
    return t, Stage(spark, "table").save(R.tree_table(t))


TREE = """with t as (select 'ROOT' node_id, '' label, 'ROOT' as level, null::varchar parent_id, 0::bigint ord, ['ROOT'] path
 union all select 'R' || r_regionkey, r_name, 'L1', 'ROOT', r_regionkey, ['ROOT', 'R' || r_regionkey] from region
 union all select 'N' || n_nationkey, n_name, 'L2', 'R' || n_regionkey, n_nationkey, ['ROOT', 'R' || n_regionkey, 'N' || n_nationkey] from nation
 union all select 'C' || c_custkey, case when c_custkey % 7 = 0 then n_name when c_mktsegment = 'BUILDING' and c_custkey % 3 = 0 then '' when c_custkey % 2 = 0 then c_mktsegment else c_name end, case when c_custkey % 50 = 0 then 'L4' else 'L3' end, 'N' || c_nationkey, c_custkey,
  ['ROOT', 'R' || n_regionkey, 'N' || c_nationkey, 'C' || c_custkey] from customer join nation on c_nationkey = n_nationkey
 union all select 'S' || s_suppkey, 'Supplier of goods number ' || s_suppkey, 'L3', 'N' || s_nationkey, s_suppkey, ['ROOT', 'R' || n_regionkey, 'N' || s_nationkey, 'S' || s_suppkey] from supplier join nation on s_nationkey = n_nationkey),
k as (select parent_id, count(*) n from t where parent_id is not null group by 1),
tt as (select t.*, cast(len(t.path) - 1 as integer) depth, p.label parent_label, coalesce(k.n, 0) children_count, coalesce(s.n - 1, 0) sibling_count, k.n is null is_leaf, length(t.label) label_len
 from t left join t p on t.parent_id = p.node_id left join k on k.parent_id = t.node_id left join k s on s.parent_id = t.parent_id),
ln as (select node_id, string_agg(pl, '>' order by i) path_labels from (select x.node_id, x.i, q.label pl from (select node_id, unnest(path) pid, unnest(range(1, len(path) + 1)) i from t) x join t q on q.node_id = x.pid) group by 1)"""


@query("tr01_build_tree", TREE + " select node_id, label, level, parent_id from t")
def tr01(spark, d):
    return tree(spark, d).select("node_id", "label", "level", "parent_id")


@query("jn04_links_of_known_nodes", TREE + " select parent_id, count(*) n from t where parent_id is not null and parent_id <> 'ROOT' group by 1")
def jn04(spark, d):
    return tree(spark, d).filter("parent_id is not null and parent_id <> 'ROOT'").groupBy("parent_id").agg(F.count("*").alias("n"))


@query("tr02_add_samples", TREE + " select parent_id, count(*) n from (select 'N' || c_nationkey parent_id from customer union all select parent_id from t where parent_id is not null) group by 1")
def tr02(spark, d):
    m = table(spark, d, "customer").select(F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("node_id"), F.concat(F.lit("s"), F.col("c_custkey").cast("string")).alias("member_id"))
    return R.add_samples(tree(spark, d), m).filter("parent_id is not null").groupBy("parent_id").agg(F.count("*").alias("n"))


@query("tr03_leaf_paths", TREE + " select tt.node_id leaf_id, array_to_string(path[2:], '/') path_ids, replace(substr(ln.path_labels, 2), '>', '/') path_labels from tt join ln on tt.node_id = ln.node_id where is_leaf")
def tr03(spark, d):
    return R.leaf_paths(full(spark, d)[1])


@query("tr04_path_columns", TREE + " select t.node_id, path[2] l1_id, path[3] l2_id, path[4] l3_id, a.label l1_label, b.label l2_label from t left join t a on a.node_id = path[2] left join t b on b.node_id = path[3]".replace("left join t a on a.node_id = path[2]", "left join t a on a.node_id = t.path[2]").replace("left join t b on b.node_id = path[3]", "left join t b on b.node_id = t.path[3]").replace("select t.node_id, path[2] l1_id, path[3] l2_id, path[4] l3_id", "select t.node_id, t.path[2] l1_id, t.path[3] l2_id, t.path[4] l3_id"))
def tr04(spark, d):
    c = R.path_columns(full(spark, d)[1])
    return c.select("node_id", F.col("L1_id").alias("l1_id"), F.col("L2_id").alias("l2_id"), F.col("L3_id").alias("l3_id"), F.col("L1_label").alias("l1_label"), F.col("L2_label").alias("l2_label"))


@query("tr05_index", TREE + " select node_id, parent_id from t")
def tr05(spark, d):
    """The adjacency relation is the index: ids trimmed, parent by id."""
    return tree(spark, d).select(T.strip(F.col("node_id")).alias("node_id"), "parent_id")


@query("tr06_move_nodes", TREE + " select node_id, case when starts_with(node_id, 'C') and ord % 5 = 0 then 'N0' when node_id = 'N3' then 'R0' else parent_id end parent_id from t")
def tr06(spark, d):
    """Customers move to N0, N3 to R0; R1 below its own N1 and S1 to itself are refused."""
    t = tree(spark, d)
    n1 = table(spark, d, "nation").filter("n_regionkey = 1").agg(F.concat(F.lit("N"), F.min("n_nationkey").cast("string")).alias("new_parent_id")).withColumn("node_id", F.lit("R1"))
    m = t.filter(F.col("node_id").startswith("C") & (F.col("ord") % 5 == 0)).select("node_id", F.lit("N0").alias("new_parent_id"))
    m = m.union(spark.createDataFrame([("N3", "R0"), ("S1", "S1"), ("S2", "nowhere")], "node_id string, new_parent_id string")).unionByName(n1)
    return R.move_nodes(t, m).select("node_id", "parent_id")


@query("tr07_remove_subtrees", TREE + " select node_id from t where not (list_contains(path, 'R1') or list_contains(path, 'N0') or list_contains(path, 'C7'))")
def tr07(spark, d):
    return R.remove_subtrees(tree(spark, d), spark.createDataFrame([("R1",), ("N0",), ("C7",), ("none",)], "node_id string")).select("node_id")


@query("tr08_promotable", TREE + ", j as (select c.node_id child_id, p.node_id parent_id, p.parent_id grandparent_id, k.n = 1 and p.parent_id is not null and not (p.parent_id = 'ROOT' and c.level in ('L3', 'L4')) ok from t c join t p on c.parent_id = p.node_id join k on k.parent_id = p.node_id) select parent_id, ok, count(*) n from j group by all")
def tr08(spark, d):
    return R.promotable(tree(spark, d)).groupBy("parent_id", "ok").agg(F.count("*").alias("n"))


@query("tr09_absorb", TREE + " select node_id, case when parent_id in ('N1', 'N2') then 'N3' else parent_id end parent_id from t where node_id not in ('N1', 'N2')")
def tr09(spark, d):
    """N1 into N2 into N3; N4 and N5 into each other is refused."""
    m = spark.createDataFrame([("N1", "N2"), ("N2", "N3"), ("N4", "N5"), ("N5", "N4"), ("N6", "none")], "loser string, winner string")
    return R.absorb(tree(spark, d), m).select("node_id", "parent_id")


@query("tr10_add_children", TREE + " select node_id, parent_id from t union all select * from (values ('new', 'R0'), ('N0_2', 'R1'))")
def tr10(spark, d):
    n = spark.createDataFrame([("new", "x", "L2", "R0"), ("N0", "y", "L2", "R1"), ("z", "z", "L2", "none")], "node_id string, label string, level string, parent_id string")
    return R.add_children(tree(spark, d), n).select("node_id", "parent_id")


@query("tr11_vertical_collapse", TREE + " select node_id, case when parent_id = 'N1' then (select parent_id from t where node_id = 'N1') else parent_id end parent_id, case when node_id = 'N2' then 'renamed' else label end label from t where node_id <> 'N1'")
def tr11(spark, d):
    """N1 is absorbed, N2 renamed; promoting N3, which has siblings, is refused."""
    dec = spark.createDataFrame([("N1", "absorb", None), ("N2", "rename", "renamed"), ("N3", "promote", None), ("N4", "keep", None), ("zz", "absorb", None)], "child_id string, action string, label string")
    return R.collapse(tree(spark, d), dec).select("node_id", "parent_id", "label")


@query("tr12_level_jumps", TREE + " select c.node_id, c.parent_id from t c join t p on c.parent_id = p.node_id where p.level <> 'ROOT' and cast(substr(c.level, 2) as integer) - cast(substr(p.level, 2) as integer) > 1")
def tr12(spark, d):
    return R.level_jumps(tree(spark, d))


@query("tr13_fan_out", TREE + " select parent_id, n from k where n > 7")
def tr13(spark, d):
    return R.fan_out(tree(spark, d))


def link_tree(spark, d):
    """Both parent-link tables as one deep tree."""
    l = newest_links(table(spark, d, "tree_parent_links_l3_to_l2"), table(spark, d, "tree_parent_links_l4_to_l3"))
    return l.select(F.col("node").alias("node_id"), F.lit("").alias("label"), F.substring("node", 1, 2).alias("level"), F.col("parent").alias("parent_id"), F.lit(0).cast("long").alias("ord"))


def _flatten_sql(rounds=10, deepest=4, most=3):
    """Every round as CTEs of its own: nodes that go (h), where their children land (e), the rest (f)."""
    sql = _CLIMB + f""", f0 as materialized (select n.node, n.parent, solved.met = len(solved.path) and len(solved.path) - 1 >= {deepest} deep from n join solved on solved.node = n.node)"""
    for i in range(rounds):
        sql += f""",
h{i} as materialized (select f.node src, f.parent dst from f{i} f join (select parent p, count(*) k from f{i} where parent is not null group by 1) on p = f.node where f.deep and k <= {most}),
c{i}(src, cur) as (select src, dst from h{i} union all select c{i}.src, h{i}.dst from c{i} join h{i} on h{i}.src = c{i}.cur),
e{i} as materialized (select src, cur from c{i} where cur not in (select src from h{i})),
f{i + 1} as materialized (select f.node, coalesce(e.cur, f.parent) parent, f.deep from f{i} f left join e{i} e on e.src = f.parent where f.node not in (select src from h{i}))"""
    return sql + f" select node node_id, parent parent_id from f{rounds}"


@query("tr14_flatten_depth", _flatten_sql())
def tr14(spark, d):
    return R.flatten_depth(link_tree(spark, d)).select("node_id", "parent_id")


@query("tr15_insert_bridges", TREE + """, b as (select 'R0_BR_' || substr(md5('R0_half_BR'), 1, 6) id)
 select node_id, case when parent_id = 'R0' and ord % 2 = 0 then b.id else parent_id end parent_id, level from t, b union all select b.id, 'R0', 'L2' from b where exists (select 1 from t where parent_id = 'R0' and ord % 2 = 0)""")
def tr15(spark, d):
    t = tree(spark, d)
    b = t.filter("parent_id = 'R0' and ord % 2 = 0").select(F.lit("R0").alias("parent_id"), F.lit("half").alias("label"), F.col("node_id").alias("child_id"))
    return R.insert_bridges(t, b).select("node_id", "parent_id", "level")


@query("tr16_depth", TREE + " select node_id, cast(len(path) - 1 as integer) depth from t")
def tr16(spark, d):
    return R.tree_paths(tree(spark, d)).select("node_id", "depth")


@query("jn10_sibling_pairs", TREE + ", o as (select node_id, parent_id, row_number() over (partition by parent_id order by ord, node_id) r from t where parent_id is not null) select a.node_id id_a, b.node_id id_b from o a join o b on a.parent_id = b.parent_id and b.r between a.r + 1 and a.r + 49")
def jn10(spark, d):
    """Siblings in order, each with the next 49: all pairs of parents with up to 50 children, a band of
    the larger ones, whose close pairs sibling_duplicates() finds without listing all."""
    t = tree(spark, d).select("parent_id", "ord", "node_id")
    return sliding_pairs(t, ["parent_id"], [F.col("ord"), F.col("node_id")], "node_id", 49)


@query("jn11_same_level_band", TREE + ", o as (select node_id, parent_id, level, row_number() over (partition by level order by ord, node_id) r from t where level in ('L2', 'L3')) select a.node_id id_a, b.node_id id_b from o a join o b on a.level = b.level and b.r between a.r + 1 and a.r + 49 and a.parent_id <> b.parent_id")
def jn11(spark, d):
    """Nodes of L2 and L3 with the next 49 of their level, where the parents differ."""
    return cross_parent_pairs(tree(spark, d), 49)


def cross_parent_pairs(t, band):
    rows = t.filter("level in ('L2', 'L3')").select("level", "ord", "node_id", F.struct("node_id", "parent_id").alias("x"))
    pairs = sliding_pairs(rows, ["level"], [F.col("ord"), F.col("node_id")], "x", band)
    return pairs.filter("id_a.parent_id <> id_b.parent_id").select(F.col("id_a.node_id").alias("id_a"), F.col("id_b.node_id").alias("id_b"))


@query("jn09_relatives", TREE + " select node_id, parent_id, children_count, sibling_count from tt")
def jn09(spark, d):
    return full(spark, d)[1].select("node_id", "parent_id", "children_count", "sibling_count")


# redirects: error events redirect their id to the next one -----------------------------------------

_OPS = "ops as (select event_id::varchar src, (event_id + 1 + user_id % 3)::varchar dst from events where event_type = 'error')"
_CHASE = f"with recursive {_OPS}, r(src, cur) as (select src, dst from ops union all select r.src, ops.dst from r join ops on ops.src = r.cur), fin as (select r.src, r.cur dst from r where not exists (select 1 from ops where ops.src = r.cur))"


def redirects(spark, d):
    return table(spark, d, "events").filter("event_type = 'error'").select(F.col("event_id").cast("string").alias("src"), (F.col("event_id") + 1 + F.col("user_id") % 3).cast("string").alias("dst"))


@query("tr20_chase_redirects", _CHASE + " select src, dst from fin")
def tr20(spark, d):
    return L.chase(redirects(spark, d))


@query("tr18_merge_redirects", f"with recursive {_OPS}, m as (select src, case when cast(src as bigint) % 4 = 0 then (cast(src as bigint) + 2)::varchar else dst end dst from ops), r(src, cur) as (select src, dst from m union all select r.src, m.dst from r join m on m.src = r.cur) select r.src, r.cur dst from r where not exists (select 1 from m where m.src = r.cur)")
def tr18(spark, d):
    r = redirects(spark, d)
    later = r.filter("cast(src as bigint) % 4 = 0").select("src", (F.col("src").cast("bigint") + 2).cast("string").alias("dst"))
    return L.merge_redirects(r, later)


@query("tr19_final_membership", _CHASE + " select e.event_id::varchar member_id, e.event_id::varchar original_node_id, coalesce(fin.dst, e.event_id::varchar) final_node_id from events e left join fin on fin.src = e.event_id::varchar")
def tr19(spark, d):
    m = table(spark, d, "events").select(F.col("event_id").cast("string").alias("member_id"), F.col("event_id").cast("string").alias("original_node_id")).withColumn("final_node_id", F.col("original_node_id"))
    return L.apply_redirects(m, L.chase(redirects(spark, d)), "final_node_id")


@query("tr21_audit_operations", TREE + """, o as (select row_number() over (order by node_id) seq, list_extract(['rename', 'move', 'merge', 'split'], cast(ord % 4 + 1 as bigint)) as type, node_id, case when ord % 6 = 0 then 'none' when ord % 6 = 1 then node_id else 'N1' end target from t where level = 'L3'),
 q as (select o.*, a.path ap, b.path bp, b.node_id bn from o left join t a on a.node_id = o.node_id left join t b on b.node_id = o.target)
 select node_id, case when type = 'split' then 'unknown type' when type = 'rename' then 'ok' when bn is null then 'unknown target' when node_id = target then 'same node' when ap[2] <> bp[2] then 'other branch' when list_contains(bp, node_id) then 'below itself' else 'ok' end message from q""")
def tr21(spark, d):
    """Operations on all nodes of L3; every operation meets what earlier ones left."""
    return _applied(spark, d)[1].select("node_id", "message")


def _applied(spark, d):
    t, f = full(spark, d)
    kind = F.element_at(F.array(*map(F.lit, ("rename", "move", "merge", "split"))), (F.col("ord") % 4 + 1).cast("int"))
    target = F.when(F.col("ord") % 6 == 0, "none").when(F.col("ord") % 6 == 1, F.col("node_id")).otherwise("N1")
    ops = f.filter("level = 'L3'").select(F.col("ord").alias("seq"), kind.alias("type"), "node_id", target.alias("target"), F.lit("renamed").alias("label"))
    return L.apply_operations(t, f, ops)


@query("tr21_applied_tree", TREE + """, o as (select node_id, list_extract(['rename', 'move', 'merge', 'split'], cast(ord % 4 + 1 as bigint)) as type, case when ord % 6 = 0 then 'none' when ord % 6 = 1 then node_id else 'N1' end target, t.path[2] b from t where level = 'L3'),
 ok as (select * from o where type = 'rename' or (target = 'N1' and b = (select path[2] from t where node_id = 'N1')))
 select t.node_id, case when ok.type = 'rename' then 'renamed' else t.label end label, case when ok.type = 'move' then 'N1' else t.parent_id end parent_id from t left join ok on ok.node_id = t.node_id and ok.type <> 'split' where not coalesce(ok.type = 'merge', false)""")
def tr21_tree(spark, d):
    """The tree after the operations."""
    return _applied(spark, d)[0].select("node_id", "label", "parent_id")


@query("tr22_level_ancestor", TREE + " select node_id, path[2] ancestor_id from t")
def tr22(spark, d):
    return R.level_ancestor(full(spark, d)[1])


@query("tr23_relevel", TREE + " select node_id, case when node_id = 'ROOT' then 'ROOT' else concat('L', len(path) - 1) end as level from t")
def tr23(spark, d):
    return R.relevel(tree(spark, d)).select("node_id", "level")


@query("tr24_flat_export", TREE + " select node_id, path[2] l1, path[3] l2, path[4] l3, path[5] l4 from tt where is_leaf")
def tr24(spark, d):
    f = full(spark, d)[1].filter("is_leaf")
    return R.path_columns(f).select("node_id", F.col("L1_id").alias("l1"), F.col("L2_id").alias("l2"), F.col("L3_id").alias("l3"), F.col("L4_id").alias("l4"))


@query("tr25_render_lines")
def tr25(spark, d):
    return R.render_lines(full(spark, d)[1])


@query("tr26_line_batches")
def tr26(spark, d):
    """Nations as blocks of their subtree's lines, packed per region into batches of 200 lines."""
    f = full(spark, d)[1]
    b = f.filter("level = 'L2'").select(F.element_at("path_ids", 2).alias("l1"), F.col("node_id").alias("block_id"), (F.col("children_count") + 1).alias("size"))
    return R.line_batches(b)


@query("tr27_pending_roots", "select distinct parent_id node_id, 'L1' as level from tree_parent_links_l3_to_l2 where parent_id <> '' and parent_id not in (select child_id from tree_parent_links_l3_to_l2) and parent_id not in (select child_id from tree_parent_links_l4_to_l3)")
def tr27(spark, d):
    """Nodes without a link of their own become first-level nodes."""
    links = [table(spark, d, f"tree_parent_links_{x}") for x in ("l3_to_l2", "l4_to_l3")]
    linked = links[0].select(F.col("child_id").alias("node_id")).union(links[1].select("child_id")).distinct()
    up = links[0].filter("parent_id <> ''").select(F.col("parent_id").alias("node_id")).distinct()
    return up.join(linked, "node_id", "left_anti").withColumn("level", F.lit("L1"))


_LOG = """ops as (select event_id seq, case event_type when 'error' then 'merge' when 'click' then 'absorb_child' else event_type end op, event_id::varchar loser, (event_id + 2)::varchar winner from events)"""


@query("tr28_log_redirects", f"with {_LOG} select loser src, winner dst from ops where op in ('merge', 'absorb_child')")
def tr28(spark, d):
    e = table(spark, d, "events")
    op = F.when(F.col("event_type") == "error", "merge").when(F.col("event_type") == "click", "absorb_child").otherwise(F.col("event_type"))
    a, b = F.col("event_id").cast("string"), (F.col("event_id") + 2).cast("string")
    ops = e.select(F.col("event_id").alias("seq"), op.alias("op"), a.alias("loser"), b.alias("winner"), a.alias("child"), b.alias("parent"))
    return L.log_redirects(ops)


@query("tr29_lineage_report", _CHASE + """, s as (select event_id::varchar sample_id, case when event_type <> 'view' then event_id::varchar end node from events),
 f as (select s.sample_id, s.node, coalesce(fin.dst, s.node) final from s left join fin on fin.src = s.node)
 select status, count(*) n from (select case when node is null then 'FILTERED_EARLY' when exists (select 1 from events e where e.event_id::varchar = f.final and e.user_id % 2 = 0) then 'ACTIVE' else 'ORPHAN' end status from f) group by 1""")
def tr29(spark, d):
    e = table(spark, d, "events").withColumn("id", F.col("event_id").cast("string"))
    initial = L.initial_nodes(e.filter("event_type <> 'view'").select(F.col("id").alias("member_id"), F.col("id").alias("node_id")))
    rep = L.lineage_report(e.select(F.col("id").alias("sample_id")), initial, L.chase(redirects(spark, d)), e.filter("user_id % 2 = 0").select(F.col("id").alias("node_id")))
    return rep.groupBy("status").agg(F.count("*").alias("n"))


@query("jn16_initial_nodes", "select member_id, arg_min(node_id, i) node_id from (select o_custkey member_id, min(o_orderkey) node_id, 1 i from orders group by 1 union all select c_custkey, c_custkey * 1000, 2 from customer) group by member_id")
def jn16(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("member_id"), (F.col("c_custkey") * 1000).alias("node_id"))
    b = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("member_id")).agg(F.min("o_orderkey").alias("node_id"))
    return L.initial_nodes(a, b)


@query("tr30_tree_table", TREE + " select tt.node_id, tt.label, tt.level, depth, parent_id, parent_label, children_count, is_leaf, cast(label_len as integer) label_len, array_to_string(path, '>') path_ids, ln.path_labels from tt join ln on ln.node_id = tt.node_id")
def tr30(spark, d):
    f = full(spark, d)[1]
    return f.select("node_id", "label", "level", "depth", "parent_id", "parent_label", "children_count", "is_leaf", "label_len", F.array_join("path_ids", ">").alias("path_ids"), F.array_join("path_labels", ">").alias("path_labels"))


@query("tr31_sibling_count", TREE + " select node_id, sibling_count from tt")
def tr31(spark, d):
    return full(spark, d)[1].select("node_id", "sibling_count")


@query("tr32_prune", TREE + ", v as (select unnest(path) node_id from t where label = 'MACHINERY') select distinct node_id from v")
def tr32(spark, d):
    t = tree(spark, d)
    return R.prune(t, t.filter("label = 'MACHINERY'").select("node_id")).select("node_id")


@query("tr33_prune_per_unit", TREE + ", v as (select label unit, unnest(path) node_id from t where starts_with(node_id, 'C') and ord % 2 = 0 and label <> '') select unit, count(distinct node_id) n_nodes from v group by unit")
def tr33(spark, d):
    t = tree(spark, d)
    v = t.filter("node_id like 'C%' and ord % 2 = 0 and label <> ''").select(F.col("label").alias("unit"), "node_id")
    return R.prune(t, v, "unit").groupBy("unit").agg(F.count("*").alias("n_nodes"))


@query("tr34_leaf_weights", TREE + ", v as (select unnest(path) node_id from tt where is_leaf) select node_id, count(*) weight from v group by 1")
def tr34(spark, d):
    return R.leaf_weights(tree(spark, d))


@query("tr35_radial_layout")
def tr35(spark, d):
    lay = R.radial_layout(tree(spark, d))
    return lay.select("node_id", "depth", *[F.round(c, 6).alias(c) for c in ("a0", "a1", "r", "x", "y")])


@query("wn12_angle_gaps")
def wn12(spark, d):
    return R.angle_gaps(R.radial_layout(tree(spark, d))).select("node_id", F.round("min_gap", 6).alias("min_gap"))


@query("jn17_overwrite_labels", TREE + " select t.node_id, coalesce(n.n_name || '!', t.label) label from t left join nation n on t.node_id = 'N' || n.n_nationkey")
def jn17(spark, d):
    names = table(spark, d, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("_i"), F.concat("n_name", F.lit("!")).alias("_l"))
    return tree(spark, d).join(names, F.col("node_id") == F.col("_i"), "left").select("node_id", F.coalesce("_l", "label").alias("label"))


@query("hp06_definitions", "select node_id, n_name definition from (select 'N' || n_nationkey node_id, n_nationkey k from nation) join nation on n_nationkey = k")
def hp06(spark, d):
    t = tree(spark, d).filter("level = 'L2'")
    names = table(spark, d, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("node_id"), F.col("n_name").alias("definition"))
    return t.join(names, "node_id").select("node_id", "definition")


@query("rp09_depth_counts", TREE + " select cast(len(path) - 1 as integer) depth, count(*) n from t group by 1")
def rp09(spark, d):
    return full(spark, d)[1].groupBy("depth").agg(F.count("*").alias("n"))


# checks ---------------------------------------------------------------------------------------------


@query("ck01_duplicate_ids", "select node_id, count(*) n from tree_nodes_l3 group by node_id having count(*) > 1")
def ck01(spark, d):
    return C.duplicate_ids(table(spark, d, "tree_nodes_l3"))


@query("ck02_multiple_parents", "select child_id, count(distinct parent_id) n from tree_parent_links_l4_to_l3 group by child_id having count(distinct parent_id) > 1")
def ck02(spark, d):
    return C.multiple_parents(table(spark, d, "tree_parent_links_l4_to_l3"))


@query("ck03_circles", _CLIMB + " select node, list_min(path[met:len(path) - 1]) circle from solved where met < len(path) and list_contains(path[met:len(path) - 1], node)")
def ck03(spark, d):
    return C.circles(newest_links(table(spark, d, "tree_parent_links_l3_to_l2"), table(spark, d, "tree_parent_links_l4_to_l3")))


@query("ck04_empty_labels", TREE + " select node_id from t where level <> 'ROOT' and trim(label) = ''")
def ck04(spark, d):
    return C.empty_labels(tree(spark, d))


@query("ck05_orphans", "select child_id node_id from tree_parent_links_l4_to_l3 group by child_id having bool_and(parent_id is null or parent_id not in (select child_id from tree_parent_links_l4_to_l3))")
def ck05(spark, d):
    l = table(spark, d, "tree_parent_links_l4_to_l3").select(F.col("child_id").alias("node_id"), "parent_id")
    some = l.join(l.select(F.col("node_id").alias("parent_id")).distinct(), "parent_id", "left_semi").select("node_id").distinct()
    return C.orphans(l).distinct().join(some, "node_id", "left_anti")


@query("ck06_level_depth_mismatch", TREE + " select node_id, level, depth from tt where level <> 'ROOT' and cast(substr(level, 2) as integer) <> depth")
def ck06(spark, d):
    return C.level_depth_mismatch(full(spark, d)[1])


@query("ck07_oversized", TREE + " select node_id, children_count from tt where children_count > 8")
def ck07(spark, d):
    return C.oversized(full(spark, d)[1])


@query("ck08_long_labels", TREE + " select node_id, cast(label_len as integer) label_len from tt where label_len > 25")
def ck08(spark, d):
    return C.long_labels(full(spark, d)[1])


@query("ck09_sibling_duplicates", TREE + " select parent_id, label, count(*) n, min(node_id) first_id from t where parent_id is not null and label <> '' group by all having count(*) > 1")
def ck09(spark, d):
    return C.sibling_duplicates(tree(spark, d))


@query("ck10_equals_parent_label", TREE + " select node_id from tt where label <> '' and label = parent_label")
def ck10(spark, d):
    return C.equals_parent_label(full(spark, d)[1])


@query("ck11_cross_branch_labels", TREE + " select label, count(distinct parent_label) n_parents, count(*) n from tt where label <> '' and parent_label is not null group by label having count(distinct parent_label) > 1")
def ck11(spark, d):
    return C.cross_branch_labels(full(spark, d)[1])


@query("ck12_examples", TREE + " select node_id, cast(label_len as integer) label_len from tt where label_len > 25 order by label_len desc, node_id limit 20")
def ck12(spark, d):
    """First 20 examples of a check, as a report shows them."""
    return C.examples(C.long_labels(full(spark, d)[1]), F.desc("label_len"), "node_id")


@query("rp05_structure_report", TREE + """ select 'size' as section, 'nodes' metric, count(*)::double as value from tt union all select 'size', 'edges', count(parent_id)::double from tt union all select 'size', 'leaves', count(*) filter (is_leaf)::double from tt union all select 'size', 'max_depth', max(depth)::double from tt
 union all select 'size', 'mean_children', round_even(avg(children_count) filter (children_count > 0), 2) from tt union all select 'issue', 'duplicate_ids', 0 union all select 'issue', 'empty_labels', count(*) from t where level <> 'ROOT' and label = '' union all select 'issue', 'orphans', 0
 union all select 'issue', 'level_depth_mismatch', count(*) from tt where level <> 'ROOT' and coalesce(try_cast(substr(level, 2) as integer), depth) <> depth union all select 'warning', 'oversized', count(*) from tt where children_count > 8 union all select 'warning', 'long_labels', count(*) from tt where label_len > 25
 union all select 'warning', 'sibling_duplicates', count(*) from (select 1 from t where parent_id is not null and label <> '' group by parent_id, label having count(*) > 1) union all select 'warning', 'equals_parent_label', count(*) from tt where label <> '' and label = parent_label
 union all select 'warning', 'cross_branch_labels', count(*) from (select 1 from tt where label <> '' and parent_label is not null group by label having count(distinct parent_label) > 1)""")
def rp05(spark, d):
    t, f = full(spark, d)
    return C.report(t, f)


@query("ag07_histograms", TREE + " select level, depth, count(*) n from tt group by all")
def ag07(spark, d):
    return full(spark, d)[1].groupBy("level", "depth").agg(F.count("*").alias("n"))


@query("ag08_top_category_sizes", TREE + " select path[2] l1, count(*) filter (is_leaf) leaves, max(depth) max_depth from tt where len(path) > 1 group by 1")
def ag08(spark, d):
    f = full(spark, d)[1].filter(F.size("path_ids") > 1)
    return f.groupBy(F.element_at("path_ids", 2).alias("l1")).agg(F.count_if("is_leaf").alias("leaves"), F.max("depth").alias("max_depth"))


@query("ag09_mean_children", TREE + " select round_even(avg(children_count) filter (children_count > 0), 2) mean_children, count(*) filter (children_count > 0) inner_nodes from tt")
def ag09(spark, d):
    f = full(spark, d)[1]
    return f.agg(F.bround(F.avg(F.when(F.col("children_count") > 0, F.col("children_count"))), 2).alias("mean_children"), F.count_if(F.col("children_count") > 0).alias("inner_nodes"))
