"""P6: both parent-link tables to full hierarchies."""

from pyspark.sql import functions as F

from arborlake.operators.hierarchy import descendants, hierarchy, newest_links
from arborlake.plans import query
from arborlake.runtime import table

_LINKS = """
with recursive l as (
  select child_id, parent_id, loaded_at from tree_parent_links_l3_to_l2
  union all select child_id, parent_id, loaded_at from tree_parent_links_l4_to_l3),
n as (select child_id node, nullif(arg_max(struct_pack(p := parent_id), struct_pack(t := loaded_at, p := coalesce(parent_id, ''))).p, '') parent
      from l where child_id is not null group by child_id)"""

#: Climbs from every node; a climb stops at a root or when it meets itself.
_CLIMB = _LINKS + """,
up(node, cur, path) as (
  select node, node, [node] from n
  union all
  select up.node, n.parent, list_append(up.path, n.parent) from up join n on n.node = up.cur
  where n.parent is not null and list_position(up.path, up.cur) = len(up.path)),
longest as (select node, arg_max(path, len(path)) path from up group by node),
solved as (select node, path, list_position(path, path[-1]) met from longest)"""


def _links(spark, d):
    return newest_links(table(spark, d, "tree_parent_links_l3_to_l2"), table(spark, d, "tree_parent_links_l4_to_l3"))


@query("p6_found", _CLIMB + """
select node node_id, case when met < len(path) then list_min(path[met:len(path) - 1]) else path[-1] end root_id,
       cast(case when met < len(path) then -1 else len(path) - 1 end as integer) depth
from solved""")
def p6_found(spark, d):
    return hierarchy(_links(spark, d), with_paths=False).filter(~F.col("implicit")).select(
        F.col("node").alias("node_id"), F.col("root").alias("root_id"), "depth"
    )


@query("p6_paths", _CLIMB + """
select node node_id, array_to_string(list_reverse(path), ' > ') path, cast(len(path) - 1 as integer) depth
from solved where met = len(path)""")
def p6_paths(spark, d):
    """Full path of every node that hangs on a root."""
    return hierarchy(_links(spark, d)).filter("not implicit and path is not null").select(
        F.col("node").alias("node_id"), F.array_join("path", " > ").alias("path"), "depth"
    )


_ABOVE = """, above as (select node, path[2:case when met < len(path) then met - 1 else len(path) end] up, met from solved),
below as (select node, unnest(up) a, unnest(range(1, len(up) + 1)) dist from above)"""


@query("p6_descendants", _CLIMB + _ABOVE + """
select a ancestor_id, count(*) n_descendants, min(node) first_descendant, cast(max(dist) as integer) height
from below group by a""")
def p6_descendants(spark, d):
    """Number of descendants, height and smallest descendant per node with any, nodes below circles
    included; nodes on a circle, each below all others, are told by p6_circles."""
    return descendants(hierarchy(_links(spark, d)), below_circles=True).groupBy(F.col("ancestor").alias("ancestor_id")).agg(
        F.count("*").alias("n_descendants"), F.min("node").alias("first_descendant"), F.max("distance").cast("int").alias("height")
    )


@query("p6_sizes", _CLIMB + _ABOVE + """
, n_below as (select a, count(*) k from below group by a)
select node node_id, case when met > 1 or len(path) = 1 then 1 + coalesce(k, 0) end subtree_size
from (select node, path, met from solved) left join n_below on a = node""")
def p6_sizes(spark, d):
    """Subtree size, the node included, of every child; null on circles."""
    return hierarchy(_links(spark, d), with_paths=False).filter("not implicit").select(F.col("node").alias("node_id"), "subtree_size")


@query("p6_circles", _CLIMB + """
select list_min(path[met:len(path) - 1]) circle_id, count(*) n_nodes, count(*) filter (list_contains(path[met:len(path) - 1], node)) n_on_circle
from solved where met < len(path) group by 1""")
def p6_circles(spark, d):
    """Circles with the number of nodes on them and on or below them."""
    return hierarchy(_links(spark, d), with_paths=False).filter("depth = -1").groupBy(F.col("root").alias("circle_id")).agg(
        F.count("*").alias("n_nodes"), F.count_if("on_cycle").alias("n_on_circle")
    )
