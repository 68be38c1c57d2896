"""Queries: reachability, levels, paths (inventory T)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import paths as paths_of
from graphloom.operators.match import window
from graphloom.operators.traverse import bfs, edge_visits, neighbours_within, overlay, walks_from
from graphloom.plans.lookups import EDGES
from graphloom.sources.graph import memory_graph, purchase_graph
from graphloom.sources.tables import table

#: Sources of multi-source queries: vertices whose id is divisible by 20, against all edges.
BLOCK = 20


def _roots(edges: DataFrame, kind: str) -> DataFrame:
    return edges.where((F.col("edge_type") == kind) & (F.col("src") % BLOCK == 0)).select(F.col("src").alias("root")).distinct()


def t01_walks(spark: SparkSession, d: str) -> DataFrame:
    e = purchase_graph(spark, d)
    return walks_from(_roots(e, "NEXT_USER"), e, "NEXT_USER", 2, 3)


def t01_chain_walks(spark: SparkSession, d: str) -> DataFrame:
    e = memory_graph(spark, d).edges
    return walks_from(_roots(e, "SUPERSEDES"), e, "SUPERSEDES", 1, 6)


def t03_zero_hops(spark: SparkSession, d: str) -> DataFrame:
    e = memory_graph(spark, d).edges
    return walks_from(_roots(e, "MERGED_INTO"), e, "MERGED_INTO", 0, 3)


def t04_reach_count(spark: SparkSession, d: str) -> DataFrame:
    e = memory_graph(spark, d).edges
    return walks_from(_roots(e, "SUPERSEDES"), e, "SUPERSEDES", 1, 4).groupBy("root").agg(F.count(F.lit(1)).alias("n"))


def t05_reach_window(spark: SparkSession, d: str) -> DataFrame:
    e = memory_graph(spark, d).edges
    return window(walks_from(_roots(e, "SUPERSEDES"), e, "SUPERSEDES", 1, 4), [F.col("root").asc(), F.col("v").asc()], skip=10, limit=100)


def t06_levels(spark: SparkSession, d: str) -> DataFrame:
    e = memory_graph(spark, d).edges
    starts = e.where((F.col("edge_type") == "MERGED_INTO") & (F.col("src") % BLOCK == 0)).select(F.col("src").alias("v")).distinct()
    return bfs(starts, e, ["MERGED_INTO", "SUPERSEDES"], 4, direction="both")


def t08_edge_visits(spark: SparkSession, d: str) -> DataFrame:
    e = purchase_graph(spark, d)
    return edge_visits(_roots(e, "NEXT_USER"), e, "NEXT_USER", 3)


def t09_overlay(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "edge_mutations").where("src is not null and dst is not null and edge_type is not null")
    base = raw.where("cell_id = 'cell-00'").select("edge_type", "src", "dst").distinct()
    delta = raw.where("cell_id <> 'cell-00'").select("edge_type", "src", "dst", F.col("mutation_id").alias("seq"), (F.col("mutation_id") % 3 != 0).alias("exists"))
    return overlay(base, delta)


def t10_paths(spark: SparkSession, d: str) -> DataFrame:
    """Sources are the users whose id is divisible by 20, targets all users."""
    e = purchase_graph(spark, d)
    ends = e.where("src % 20 = 0").select(F.col("src").alias("v")).distinct()
    found = paths_of.simple_paths(e, "NEXT_USER", ends, max_len=2, weight="weight", cost="cost")
    best = paths_of.ranked(found, 3)
    return best.select("source", "target", "rank", "length", F.array_join("nodes", ",").alias("nodes"), F.round("weight", 6).alias("weight"), F.round("cost", 4).alias("cost"))


def t11_single_source(spark: SparkSession, d: str) -> DataFrame:
    e = memory_graph(spark, d).edges
    roots = _roots(e, "SUPERSEDES").select(F.col("root").alias("v"))
    found = paths_of.simple_paths(e, "SUPERSEDES", roots, max_len=3)
    return paths_of.ranked(found, 2, per_target=False).select("source", "target", "rank", F.array_join("nodes", ",").alias("nodes"))


def t13_pairwise(spark: SparkSession, d: str) -> DataFrame:
    """Sources are the vertices whose id is divisible by 20, targets all; a pair counts once."""
    e = memory_graph(spark, d).edges
    ends = e.where((F.col("edge_type") == "MERGED_INTO") & (F.col("dst") % 20 == 0)).select(F.col("dst").alias("v")).distinct()
    found = paths_of.simple_paths(e, "MERGED_INTO", ends, max_len=3, direction="both", pairwise=True)
    return paths_of.ranked(found, 0).select("source", "target", "length", F.array_join("nodes", ",").alias("nodes"))


def t16_max_cost(spark: SparkSession, d: str) -> DataFrame:
    e = purchase_graph(spark, d)
    ends = e.where("src % 20 = 0").select(F.col("src").alias("v")).distinct()
    found = paths_of.simple_paths(e, "NEXT_USER", ends, max_len=2, weight="weight", cost="cost", max_cost=60.0)
    return paths_of.ranked(found, 1).select("source", "target", F.array_join("nodes", ",").alias("nodes"), F.round("cost", 4).alias("cost"))


def t18_parallel_paths(spark: SparkSession, d: str) -> DataFrame:
    r = memory_graph(spark, d).relationships
    roots = r.where("edge_type = 'RELATES_TO' and src % 20 = 0").select(F.col("src").alias("v")).distinct()
    found = paths_of.simple_paths(r, "RELATES_TO", roots, max_len=2)
    out = found.select("source", F.array_join("nodes", ",").alias("nodes"), F.array_join(F.transform("rels", lambda x: x["relationship_id"].cast("string")), ",").alias("rels"))
    return out


def t19_fair_variants(spark: SparkSession, d: str) -> DataFrame:
    r = memory_graph(spark, d).relationships
    roots = r.where("edge_type = 'RELATES_TO' and src % 20 = 0").select(F.col("src").alias("v")).distinct()
    found = paths_of.fair_variants(paths_of.simple_paths(r, "RELATES_TO", roots, max_len=2), 3)
    return found.select("source", "target", "rank", F.array_join("nodes", ",").alias("nodes"), F.array_join(F.transform("rels", lambda x: x["relationship_id"].cast("string")), ",").alias("rels"))


def t21_path_nodes(spark: SparkSession, d: str) -> DataFrame:
    g = memory_graph(spark, d)
    roots = _roots(g.edges, "SUPERSEDES").select(F.col("root").alias("v"))
    found = paths_of.load_paths(paths_of.simple_paths(g.edges, "SUPERSEDES", roots, max_len=2), g.vertices, ["logical_key"])
    keys = F.array_join(F.transform("path_nodes", lambda n: F.coalesce(n["logical_key"], F.lit("-"))), ">")
    return found.select("source", "target", "length", keys.alias("keys"))


def t21_path_relationships(spark: SparkSession, d: str) -> DataFrame:
    """Paths of records with the records' own properties."""
    r = memory_graph(spark, d).relationships
    roots = r.where("edge_type = 'RELATES_TO' and src % 20 = 0").select(F.col("src").alias("v")).distinct()
    found = paths_of.load_relationships(paths_of.simple_paths(r, "RELATES_TO", roots, max_len=2), r, ["cell_id"])
    cells = F.array_join(F.transform("path_rels", lambda x: F.coalesce(x["cell_id"], F.lit("-"))), ">")
    ids = F.array_join(F.transform("path_rels", lambda x: x["relationship_id"].cast("string")), ",")
    return found.select("source", "target", ids.alias("rels"), cells.alias("cells"))


def t25_neighbours_within(spark: SparkSession, d: str) -> DataFrame:
    g = memory_graph(spark, d)
    return neighbours_within(g.edges, "ABOUT", g.vertices.where("active").select(F.col("id").alias("v")))


NAMES = "t01_walks t01_chain_walks t03_zero_hops t04_reach_count t05_reach_window t06_levels t08_edge_visits t09_overlay t10_paths t11_single_source t13_pairwise t16_max_cost t18_parallel_paths t19_fair_variants t21_path_nodes t21_path_relationships t25_neighbours_within"
QUERIES = {n: globals()[n] for n in NAMES.split()}

NEXT = """steps as (
  select user_id as src, lead(user_id) over w as dst, (epoch_us(lead(ts) over w) - epoch_us(ts)) / 1e6 as weight, value from events where event_type = 'purchase' window w as (order by ts, event_id)),
hops as (select src, dst, min(weight) as weight, min(value) as cost from steps where dst is not null and src <> dst group by src, dst)"""


def _walk(source: str, kind: str, low: int, high: int) -> str:
    where = f"where edge_type = '{kind}'" if kind else ""
    return f"""e as (select src, dst from {source} {where}), r as (select distinct src as root from e where src % 20 = 0),
w(root, v, hop) as (select root, root, 0 from r union select w.root, e.dst, w.hop + 1 from w join e on e.src = w.v where w.hop < {high}),
found as (select distinct root, v from w where hop >= {low})"""


_CHAIN = f"with recursive {EDGES}, "
_PATHS2 = """p as (
  select src as source, dst as target, [src, dst] as nodes, weight, cost, 1 as length from hops
  union all select a.src, b.dst, [a.src, a.dst, b.dst], a.weight + b.weight, a.cost + b.cost, 2 from hops a join hops b on b.src = a.dst and b.dst <> a.src)"""
_SUPER = """s as (select src, dst from edges where edge_type = 'SUPERSEDES' and src <> dst),
p as (
  select src as source, dst as target, [src, dst] as nodes, 1 as length from s where src % 20 = 0
  union all select a.src, b.dst, [a.src, a.dst, b.dst], 2 from s a join s b on b.src = a.dst and b.dst <> a.src where a.src % 20 = 0
  union all select a.src, c.dst, [a.src, a.dst, b.dst, c.dst], 3 from s a join s b on b.src = a.dst and b.dst <> a.src join s c on c.src = b.dst and c.dst <> a.src and c.dst <> a.dst where a.src % 20 = 0)"""
_PARALLEL = """r as (select mutation_id as id, src, dst from edge_mutations where edge_type = 'RELATES_TO' and src is not null and dst is not null and src <> dst),
p as (
  select src as source, dst as target, [src, dst] as nodes, [id] as rels, 1 as length from r where src % 20 = 0
  union all select a.src, b.dst, [a.src, a.dst, b.dst], [a.id, b.id], 2 from r a join r b on b.src = a.dst and b.dst <> a.src where a.src % 20 = 0)"""

SQL = {
    "t01_walks": f"with recursive {NEXT}, {_walk('hops', '', 2, 3)} select * from found",
    "t01_chain_walks": f"{_CHAIN}{_walk('edges', 'SUPERSEDES', 1, 6)} select * from found",
    "t03_zero_hops": f"{_CHAIN}{_walk('edges', 'MERGED_INTO', 0, 3)} select * from found",
    "t04_reach_count": f"{_CHAIN}{_walk('edges', 'SUPERSEDES', 1, 4)} select root, count(*) as n from found group by root",
    "t05_reach_window": f"{_CHAIN}{_walk('edges', 'SUPERSEDES', 1, 4)} select * from found order by root, v limit 100 offset 10",
    "t06_levels": f"""{_CHAIN}e as (select src as a, dst as b from edges where edge_type in ('MERGED_INTO', 'SUPERSEDES') union select dst, src from edges where edge_type in ('MERGED_INTO', 'SUPERSEDES')),
starts as (select distinct src as v from edges where edge_type = 'MERGED_INTO' and src % 20 = 0),
w(v, hop) as (select v, 0 from starts union select e.b, w.hop + 1 from w join e on e.a = w.v where w.hop < 4)
select v, min(hop)::int as hop from w where v not in (select v from starts) group by v""",
    "t08_edge_visits": f"with recursive {NEXT}, {_walk('hops', '', 0, 2)} select w.hop + 1 as hop, count(*) as visits from w join e on e.src = w.v group by w.hop",
    "t09_overlay": """with d as (select edge_type, src, dst, arg_max(mutation_id % 3 <> 0, mutation_id) as live from edge_mutations where cell_id <> 'cell-00' and src is not null and dst is not null and edge_type is not null group by all)
select distinct edge_type, src, dst from edge_mutations b where cell_id = 'cell-00' and src is not null and dst is not null and edge_type is not null
and not exists (select 1 from d where d.edge_type = b.edge_type and d.src = b.src and d.dst = b.dst) union all select edge_type, src, dst from d where live""",
    "t10_paths": f"""with {NEXT}, {_PATHS2}, q as (select *, row_number() over (partition by source, target order by weight, cost, length, nodes) as rank from p where source % 20 = 0)
select source, target, rank::int as rank, length, array_to_string(nodes, ',') as nodes, round(weight, 6) as weight, round(cost, 4) as cost from q where rank <= 3""",
    "t11_single_source": f"""with {EDGES}, {_SUPER}, q as (select *, row_number() over (partition by source order by length, nodes) as rank from p)
select source, target, rank::int as rank, array_to_string(nodes, ',') as nodes from q where rank <= 2""",
    "t13_pairwise": f"""with {EDGES}, m as (select src, dst from edges where edge_type = 'MERGED_INTO' and src <> dst), ends as (select distinct dst as v from edges where edge_type = 'MERGED_INTO' and dst % 20 = 0),
s as (select src, dst, src as x, dst as y from m union all select dst, src, src, dst from m),
p as (
  select src as source, dst as target, [src, dst] as nodes, 1 as length from s
  union all select a.src, b.dst, [a.src, a.dst, b.dst], 2 from s a join s b on b.src = a.dst and b.dst <> a.src
  union all select a.src, c.dst, [a.src, a.dst, b.dst, c.dst], 3 from s a join s b on b.src = a.dst and b.dst <> a.src join s c on c.src = b.dst and c.dst <> a.src and c.dst <> a.dst),
q as (select *, min(length) over (partition by source, target) as least from p where source < target and source in (select v from ends))
select source, target, length, array_to_string(nodes, ',') as nodes from q where length = least""",
    "t16_max_cost": f"""with {NEXT}, {_PATHS2}, q as (select *, row_number() over (partition by source, target order by weight, cost, length, nodes) as rank from p where source % 20 = 0 and cost <= 60)
select source, target, array_to_string(nodes, ',') as nodes, round(cost, 4) as cost from q where rank = 1""",
    "t18_parallel_paths": f"with {_PARALLEL} select source, array_to_string(nodes, ',') as nodes, array_to_string(rels, ',') as rels from p",
    "t19_fair_variants": f"""with {_PARALLEL}, t as (select *, row_number() over (partition by source, target, nodes order by rels) as turn from p),
q as (select *, row_number() over (partition by source, target order by turn, length, nodes) as rank from t)
select source, target, rank::int as rank, array_to_string(nodes, ',') as nodes, array_to_string(rels, ',') as rels from q where rank <= 3""",
    "t21_path_nodes": f"""with {EDGES}, {_SUPER} select p.source, p.target, p.length,
  coalesce(a.logical_key, '-') || '>' || coalesce(b.logical_key, '-') || case when p.length = 2 then '>' || coalesce(c.logical_key, '-') else '' end as keys
from p left join vertices a on a.id = p.nodes[1] left join vertices b on b.id = p.nodes[2] left join vertices c on c.id = p.nodes[3] where p.length <= 2""",
    "t21_path_relationships": """with s as (select src, dst, mutation_id as id, coalesce(cell_id, '-') as cell from edge_mutations where edge_type = 'RELATES_TO' and src is not null and dst is not null and src <> dst)
select src as source, dst as target, id::varchar as rels, cell as cells from s where src % 20 = 0
union all select a.src, b.dst, a.id || ',' || b.id, a.cell || '>' || b.cell from s a join s b on b.src = a.dst and b.dst <> a.src where a.src % 20 = 0""",
    "t25_neighbours_within": f"with {EDGES} select src, dst from edges where edge_type = 'ABOUT' and dst in (select id from vertices where active)",
}
