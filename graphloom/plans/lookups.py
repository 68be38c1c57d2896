"""Queries: scans, lookups, projections and predicates (inventory S, J, P, O)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import predicates as P
from graphloom.operators import scan
from graphloom.operators.match import Match, prop, window
from graphloom.sources.graph import memory_graph, order_graph
from graphloom.sources.tables import table


def s01_id_seek(spark: SparkSession, d: str) -> DataFrame:
    ends = memory_graph(spark, d).edges.where("edge_type = 'MERGED_INTO'").select(F.col("dst").alias("id"))
    return scan.seek(ends, table(spark, d, "vertices").select("id", "logical_key")).distinct()


def s02_label_scan(spark: SparkSession, d: str) -> DataFrame:
    return scan.with_labels(table(spark, d, "vertices"), "Fact").select("id")


def s03_property_scan(spark: SparkSession, d: str) -> DataFrame:
    return scan.with_property(table(spark, d, "vertices"), "context_id", "ctx-04040404").select("id", "logical_key")


def s04_prefix_scan(spark: SparkSession, d: str) -> DataFrame:
    return scan.with_prefix(table(spark, d, "vertices"), "logical_key", "entity:1").select("id", "logical_key")


def s05_ordered_prefix_top(spark: SparkSession, d: str) -> DataFrame:
    return scan.first_by_text(table(spark, d, "vertices").where("logical_key is not null"), "logical_key", "fact:", 50).select("id", "logical_key")


def s06_edge_scan(spark: SparkSession, d: str) -> DataFrame:
    return scan.edges_of(memory_graph(spark, d).edges, "ABOUT")


def s08_edge_property(spark: SparkSession, d: str) -> DataFrame:
    return Match(memory_graph(spark, d)).expand("f", "ABOUT", "e", parallel=True, cell_id="cell-04").returns(distinct=True, src="f", dst="e")


def s09_relationship_property(spark: SparkSession, d: str) -> DataFrame:
    """Records with one of several values: an OR of equalities on a bound relationship."""
    m = Match(memory_graph(spark, d)).expand("f", "STATED_BY", "a", rel="r", parallel=True)
    wanted = [P.equal(prop("r", "cell_id"), F.lit(c), m.rows) for c in ("cell-01", "cell-02", "cell-04")]
    return m.where(wanted[0] | wanted[1] | wanted[2]).returns(relationship_id="r.relationship_id", src="f", dst="a", cell_id="r.cell_id")


def s10_out_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours of the vertex with most turns."""
    e = memory_graph(spark, d).edges
    hub = scan.degrees(e.where("edge_type = 'HAS_TURN'")).orderBy(F.col("degree").desc(), "vertex").first()
    return scan.neighbours(e, "HAS_TURN", hub["vertex"] if hub else -1)


def s11_in_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return scan.neighbours(memory_graph(spark, d).edges, "STATED_BY", 1, incoming=True)


def _requests(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "edge_mutations").where("edge_type = 'SUPERSEDES'")
    return rows.select(F.col("mutation_id").alias("position"), F.col("src").alias("vertex"))


def s12_out_batch(spark: SparkSession, d: str) -> DataFrame:
    out = scan.neighbour_batch(_requests(spark, d), memory_graph(spark, d).edges, "ABOUT")
    return out.select("position", "vertex", F.array_join("neighbours", ",").alias("neighbours"))


def s13_in_batch(spark: SparkSession, d: str) -> DataFrame:
    out = scan.neighbour_batch(_requests(spark, d), memory_graph(spark, d).edges, "SUPERSEDES", incoming=True)
    return out.select("position", "vertex", F.array_join("neighbours", ",").alias("neighbours"))


def s15_exists_batch(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "edge_mutations").where("edge_type = 'RELATES_TO'").select(F.col("mutation_id").alias("position"), F.col("dst").alias("src"), F.col("src").alias("dst"))
    return scan.exists_batch(rows, memory_graph(spark, d).edges, "RELATES_TO")


def s16_degrees(spark: SparkSession, d: str) -> DataFrame:
    e = memory_graph(spark, d).edges
    return scan.degrees(e).withColumn("side", F.lit("out")).unionByName(scan.degrees(e, incoming=True).withColumn("side", F.lit("in")))


def s18_segments(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "edge_mutations").where("src is not null and dst is not null")
    segments = scan.to_segments(raw.where("cell_id <> 'cell-00' or cell_id is null"), F.lit(1))
    dead = raw.where("cell_id = 'cell-04'").select("edge_type", "src", "dst", F.lit(2).alias("seq"))
    return scan.from_segments(segments, dead)


def j02_properties(spark: SparkSession, d: str) -> DataFrame:
    m = Match(order_graph(spark, d)).node("c", "Customer", name="BUILDING").expand("c", "PLACED", "o").load("c", "name", "amount").load("o", "amount")
    return m.returns(c="c", segment="c.name", balance="c.amount", o="o", total="o.amount")


def j04_distinct(spark: SparkSession, d: str) -> DataFrame:
    m = Match(order_graph(spark, d)).node("o", "Order").expand("o", "CONTAINS", "p").load("o", "name").load("p", "name")
    return m.returns(distinct=True, status="o.name", brand="p.name")


def p01_two_valued(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vertices")
    return v.where(~P.equal(F.col("active"), F.lit(True)) & ~P.starts_with(F.col("logical_key"), "turn:")).select("id")


def p02_unequal(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vertices")
    return v.where(P.unequal(F.col("active"), F.lit(True)) | P.unequal(F.col("context_id"), F.lit("ctx-04040404"))).select("id")


def p02_exact_numbers(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return o.where(P.equal_number(F.col("l_partkey"), F.col("l_quantity"))).select("l_orderkey", "l_linenumber", "l_partkey")


def p02_mixed_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Equality over kinds: text never equals a number, a bigint equals a double by its exact value."""
    o = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag")
    text = P.equal(F.col("l_linenumber").cast("string"), F.col("l_linenumber"), o) | ~P.unequal(F.col("l_returnflag"), F.col("l_quantity"), o)
    return o.where(~text & P.less_equal(F.col("l_linenumber"), F.col("l_quantity"), o)).select("l_orderkey", "l_linenumber", P.equal(F.col("l_linenumber"), F.col("l_quantity"), o).alias("same"))


def p06_chain(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.where(P.between_chain(F.lit(1000.0), F.col("o_totalprice"), F.lit(50000.0))).select("o_orderkey", "o_totalprice")


def o02_null_order(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "vertices").select("id", "context_id", "active")
    return window(v, [F.col("active").desc_nulls_first(), F.col("context_id").asc_nulls_last(), F.col("id").asc()], skip=20, limit=200)


def o08_page(spark: SparkSession, d: str) -> DataFrame:
    g = memory_graph(spark, d)
    rows = Match(g).node("f", "Fact").expand("f", "ABOUT", "e").returns(f="f", e="e")
    return window(rows, [F.col("f").asc(), F.col("e").asc()], skip=64, limit=65)


NAMES = "s01_id_seek s02_label_scan s03_property_scan s04_prefix_scan s05_ordered_prefix_top s06_edge_scan s08_edge_property s09_relationship_property s10_out_neighbours s11_in_neighbours s12_out_batch s13_in_batch s15_exists_batch s16_degrees s18_segments j02_properties j04_distinct p01_two_valued p02_unequal p02_exact_numbers p02_mixed_kinds p06_chain o02_null_order o08_page"
QUERIES = {n: globals()[n] for n in NAMES.split()}

EDGES = "edges as (select distinct edge_type, src, dst from edge_mutations where src is not null and dst is not null and edge_type is not null)"
TYPED = """nodes as (
  select 1000000000000 + r_regionkey as id, 'Region' as label, r_name as name, null::double as amount from region
  union all select 2000000000000 + n_nationkey, 'Nation', n_name, null from nation
  union all select 3000000000000 + c_custkey, 'Customer', c_mktsegment, c_acctbal from customer
  union all select 4000000000000 + s_suppkey, 'Supplier', s_name, s_acctbal from supplier
  union all select 5000000000000 + p_partkey, 'Part', p_brand, p_retailprice from part
  union all select 6000000000000 + o_orderkey, 'Order', o_orderstatus, o_totalprice from orders),
links as (
  select 'IN_REGION' as edge_type, 2000000000000 + n_nationkey as src, 1000000000000 + n_regionkey as dst from nation
  union all select 'IN_NATION', 3000000000000 + c_custkey, 2000000000000 + c_nationkey from customer
  union all select 'IN_NATION', 4000000000000 + s_suppkey, 2000000000000 + s_nationkey from supplier
  union all select 'PLACED', 3000000000000 + o_custkey, 6000000000000 + o_orderkey from orders
  union all select distinct 'CONTAINS', 6000000000000 + l_orderkey, 5000000000000 + l_partkey from lineitem
  union all select distinct 'SUPPLIED_BY', 6000000000000 + l_orderkey, 4000000000000 + l_suppkey from lineitem)"""

SQL = {
    "s01_id_seek": f"with {EDGES} select distinct e.dst as id, v.logical_key from edges e left join vertices v on v.id = e.dst where e.edge_type = 'MERGED_INTO'",
    "s02_label_scan": "select id from vertices where list_contains(labels, 'Fact')",
    "s03_property_scan": "select id, logical_key from vertices where context_id = 'ctx-04040404'",
    "s04_prefix_scan": "select id, logical_key from vertices where starts_with(logical_key, 'entity:1')",
    "s05_ordered_prefix_top": "select id, logical_key from vertices where starts_with(logical_key, 'fact:') order by logical_key, id limit 50",
    "s06_edge_scan": f"with {EDGES} select * from edges where edge_type = 'ABOUT'",
    "s08_edge_property": "select distinct src, dst from edge_mutations where edge_type = 'ABOUT' and cell_id = 'cell-04' and src is not null and dst is not null",
    "s09_relationship_property": "select mutation_id as relationship_id, src, dst, cell_id from edge_mutations where edge_type = 'STATED_BY' and cell_id in ('cell-01', 'cell-02', 'cell-04') and src is not null and dst is not null",
    "s10_out_neighbours": f"with {EDGES}, h as (select src from edges where edge_type = 'HAS_TURN' group by src order by count(*) desc, src limit 1) select distinct dst from edges where edge_type = 'HAS_TURN' and src in (select src from h)",
    "s11_in_neighbours": f"with {EDGES} select distinct src from edges where edge_type = 'STATED_BY' and dst = 1",
    "s12_out_batch": f"""with {EDGES}, n as (select src, string_agg(dst::varchar, ',' order by dst) as l from edges where edge_type = 'ABOUT' group by src)
select m.mutation_id as position, m.src as vertex, coalesce(n.l, '') as neighbours from edge_mutations m left join n on n.src = m.src where m.edge_type = 'SUPERSEDES'""",
    "s13_in_batch": f"""with {EDGES}, n as (select dst, string_agg(src::varchar, ',' order by src) as l from edges where edge_type = 'SUPERSEDES' group by dst)
select m.mutation_id as position, m.src as vertex, coalesce(n.l, '') as neighbours from edge_mutations m left join n on n.dst = m.src where m.edge_type = 'SUPERSEDES'""",
    "s15_exists_batch": f"""with {EDGES} select m.mutation_id as position, m.dst as src, m.src as dst, e.src is not null as exists from edge_mutations m
left join edges e on e.edge_type = 'RELATES_TO' and e.src = m.dst and e.dst = m.src where m.edge_type = 'RELATES_TO'""",
    "s16_degrees": f"""with {EDGES} select edge_type, src as vertex, count(*) as degree, 'out' as side from edges group by all
union all select edge_type, dst, count(*), 'in' from edges group by all""",
    "s18_segments": """select distinct edge_type, src, dst from edge_mutations a where src is not null and dst is not null and (cell_id <> 'cell-00' or cell_id is null)
and not exists (select 1 from edge_mutations b where b.cell_id = 'cell-04' and b.edge_type is not distinct from a.edge_type and b.src = a.src and b.dst = a.dst)""",
    "j02_properties": f"with {TYPED} select c.id as c, c.name as segment, c.amount as balance, o.id as o, o.amount as total from nodes c join links l on l.edge_type = 'PLACED' and l.src = c.id join nodes o on o.id = l.dst where c.label = 'Customer' and c.name = 'BUILDING'",
    "j04_distinct": f"with {TYPED} select distinct o.name as status, p.name as brand from nodes o join links l on l.edge_type = 'CONTAINS' and l.src = o.id join nodes p on p.id = l.dst where o.label = 'Order'",
    "p01_two_valued": "select id from vertices where not coalesce(active = true, false) and not coalesce(starts_with(logical_key, 'turn:'), false)",
    "p02_unequal": "select id from vertices where coalesce(active <> true, false) or coalesce(context_id <> 'ctx-04040404', false)",
    "p02_exact_numbers": "select l_orderkey, l_linenumber, l_partkey from lineitem where l_partkey = l_quantity",
    "p02_mixed_kinds": "select l_orderkey, l_linenumber, l_linenumber = l_quantity as same from lineitem where l_linenumber <= l_quantity",
    "p06_chain": "select o_orderkey, o_totalprice from orders where o_totalprice > 1000 and o_totalprice < 50000",
    "o02_null_order": "select id, context_id, active from vertices order by active desc nulls first, context_id asc nulls last, id limit 200 offset 20",
    "o08_page": f"with {EDGES} select v.id as f, e.dst as e from vertices v join edges e on e.src = v.id and e.edge_type = 'ABOUT' where list_contains(v.labels, 'Fact') order by f, e limit 65 offset 64",
}
