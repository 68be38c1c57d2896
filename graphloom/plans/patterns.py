"""Queries: patterns, joins, aggregates, unions (inventory N, A, U, O)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import predicates as P
from graphloom.operators.match import Match, collected, joined_results, parallel_edges, prop, total, union, window
from graphloom.plans.lookups import EDGES, TYPED
from graphloom.sources.graph import memory_graph, order_graph


def n01_two_groups(spark: SparkSession, d: str) -> DataFrame:
    m = Match(order_graph(spark, d)).node("c", "Customer").expand("c", "PLACED", "o").load("o", "amount")
    m = m.where(P.greater(prop("o", "amount"), F.lit(100_000.0))).expand("o", "CONTAINS", "p").load("p", "amount")
    return m.where(P.less(prop("p", "amount"), F.lit(1000.0))).returns(c="c", o="o", p="p")


def n02_natural_join(spark: SparkSession, d: str) -> DataFrame:
    g = order_graph(spark, d)
    left = Match(g).node("o", "Order", name="F").expand("o", "CONTAINS", "p")
    right = Match(g).node("c", "Customer", name="MACHINERY").expand("c", "PLACED", "o")
    return left.join(right).returns(c="c", o="o", p="p")


def n07_expand_in(spark: SparkSession, d: str) -> DataFrame:
    m = Match(memory_graph(spark, d)).node("e", "Entity").expand("e", "ABOUT", "f", incoming=True)
    return m.returns(e="e", f="f")


def n08_expand_into(spark: SparkSession, d: str) -> DataFrame:
    m = Match(memory_graph(spark, d)).node("a", "Fact").expand("a", "SUPERSEDES", "b").expand("b", "SUPERSEDES", "c").expand("a", "SUPERSEDES", "c")
    return m.returns(a="a", b="b", c="c")


def n09_optional(spark: SparkSession, d: str) -> DataFrame:
    m = Match(memory_graph(spark, d)).node("f", "Fact").optional(lambda b: b.expand("f", "ABOUT", "e").load("e", "active").where(P.equal(prop("e", "active"), F.lit(True))))
    return m.returns(f="f", e="e")


def n10_match_after_optional(spark: SparkSession, d: str) -> DataFrame:
    m = Match(memory_graph(spark, d)).node("f", "Fact").optional(lambda b: b.expand("f", "ABOUT", "e")).expand("e", "HAS_ALIAS", "a")
    return m.returns(f="f", e="e", a="a")


def n12_middle_node(spark: SparkSession, d: str) -> DataFrame:
    m = Match(order_graph(spark, d)).node("n", "Nation").expand("n", "IN_NATION", "_1", incoming=True).expand("_1", "PLACED", "o")
    return m.grouped({"n": "n"}, orders=F.count(F.lit(1)))


def n13_parallel(spark: SparkSession, d: str) -> DataFrame:
    m = Match(order_graph(spark, d)).node("o", "Order", name="P").expand("o", "CONTAINS", "p", rel="r", parallel=True)
    return m.returns(o="o", p="p", quantity=prop("r", "quantity"), price=prop("r", "price"))


def n14_parallel_filtered(spark: SparkSession, d: str) -> DataFrame:
    m = Match(memory_graph(spark, d)).expand("a", "RELATES_TO", "b", rel="r", parallel=True, cell_id="cell-00")
    return m.returns(src="a", dst="b", relationship_id="r.relationship_id")


def n17_joined_results(spark: SparkSession, d: str) -> DataFrame:
    g = memory_graph(spark, d)
    left = g.vertices.where("array_contains(labels, 'Session')").select("id", "context_id")
    right = g.vertices.where("array_contains(labels, 'Alias')").groupBy("context_id").agg(F.count(F.lit(1)).alias("n"))
    out = joined_results(left, right, "context_id", ("l", "r"))
    return out.toDF(*[c.replace(".", "_") for c in out.columns])


def a01_grouped(spark: SparkSession, d: str) -> DataFrame:
    m = Match(order_graph(spark, d)).node("c", "Customer").expand("c", "PLACED", "o").load("c", "name").load("o", "name", "amount")
    return m.grouped({"segment": "c.name", "status": "o.name"}, n=F.count(F.lit(1)), whole=F.round(total(prop("o", "amount")), 2), mean=F.round(F.avg(prop("o", "amount")), 4))


def a02_empty(spark: SparkSession, d: str) -> DataFrame:
    m = Match(memory_graph(spark, d)).node("f", "NoSuchLabel").load("f", "active")
    return m.grouped({}, n=F.count(F.lit(1)), known=F.count(prop("f", "active")), whole=total(prop("f", "active").cast("bigint")))


def a03_count_present(spark: SparkSession, d: str) -> DataFrame:
    m = Match(memory_graph(spark, d)).node("f", "Fact").load("f", "active", "context_id")
    return m.grouped({"context_id": "f.context_id"}, n=F.count(F.lit(1)), known=F.count(prop("f", "active")))


def a06_collected(spark: SparkSession, d: str) -> DataFrame:
    m = Match(memory_graph(spark, d)).node("s", "Session").expand("s", "HAS_TURN", "t")
    return m.grouped({"s": "s"}, turns=F.array_join(collected(F.col("t").cast("string")), ","))


def a07_pair_counts(spark: SparkSession, d: str) -> DataFrame:
    r = memory_graph(spark, d).relationships.where("edge_type = 'STATED_BY'")
    return r.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    m = Match(order_graph(spark, d)).node("c", "Customer").expand("c", "PLACED", "o").load("o", "amount").where(P.greater(prop("o", "amount"), F.lit(50_000.0)))
    return window(m.grouped({"c": "c"}, n=F.count(F.lit(1))), [F.col("n").desc_nulls_first(), F.col("c").asc_nulls_last()], limit=10)


def u01_union_all(spark: SparkSession, d: str) -> DataFrame:
    g = memory_graph(spark, d)
    a = Match(g).node("v", "Fact").returns(id="v")
    b = window(Match(g).node("v", "Entity").returns(id="v"), [F.col("id").asc()], limit=100)
    return union(a, b, all=True)


def u02_union(spark: SparkSession, d: str) -> DataFrame:
    g = memory_graph(spark, d)
    return union(Match(g).node("f", "Fact").expand("f", "ABOUT", "e").returns(id="e"), Match(g).node("e", "Entity").returns(id="e"))


NAMES = "n01_two_groups n02_natural_join n07_expand_in n08_expand_into n09_optional n10_match_after_optional n12_middle_node n13_parallel n14_parallel_filtered n17_joined_results a01_grouped a02_empty a03_count_present a06_collected a07_pair_counts flagship u01_union_all u02_union"
QUERIES = {n: globals()[n] for n in NAMES.split()}

SQL = {
    "n01_two_groups": """select distinct 3000000000000 + o_custkey as c, 6000000000000 + o_orderkey as o, 5000000000000 + l_partkey as p from orders join lineitem on l_orderkey = o_orderkey join part on p_partkey = l_partkey
where o_custkey in (select c_custkey from customer) and o_totalprice > 100000 and p_retailprice < 1000""",
    "n02_natural_join": """select distinct 3000000000000 + c_custkey as c, 6000000000000 + o_orderkey as o, 5000000000000 + l_partkey as p from customer join orders on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey
where c_mktsegment = 'MACHINERY' and o_orderstatus = 'F'""",
    "n07_expand_in": f"with {EDGES} select v.id as e, e.src as f from vertices v join edges e on e.edge_type = 'ABOUT' and e.dst = v.id where list_contains(v.labels, 'Entity')",
    "n08_expand_into": f"""with {EDGES}, s as (select * from edges where edge_type = 'SUPERSEDES') select x.src as a, x.dst as b, y.dst as c from s x join s y on y.src = x.dst
join s z on z.src = x.src and z.dst = y.dst join vertices v on v.id = x.src where list_contains(v.labels, 'Fact')""",
    "n09_optional": f"""with {EDGES}, ok as (select e.src, e.dst from edges e join vertices v on v.id = e.dst and v.active where e.edge_type = 'ABOUT')
select v.id as f, ok.dst as e from vertices v left join ok on ok.src = v.id where list_contains(v.labels, 'Fact')""",
    "n10_match_after_optional": f"""with {EDGES} select v.id as f, e.dst as e, a.dst as a from vertices v join edges e on e.edge_type = 'ABOUT' and e.src = v.id
join edges a on a.edge_type = 'HAS_ALIAS' and a.src = e.dst where list_contains(v.labels, 'Fact')""",
    "n12_middle_node": f"with {TYPED} select n.id as n, count(*) as orders from nodes n join links a on a.edge_type = 'IN_NATION' and a.dst = n.id join links b on b.edge_type = 'PLACED' and b.src = a.src where n.label = 'Nation' group by n.id",
    "n13_parallel": "select 6000000000000 + l_orderkey as o, 5000000000000 + l_partkey as p, l_quantity as quantity, l_extendedprice as price from lineitem join orders on o_orderkey = l_orderkey where o_orderstatus = 'P'",
    "n14_parallel_filtered": "select src, dst, mutation_id as relationship_id from edge_mutations where edge_type = 'RELATES_TO' and cell_id = 'cell-00' and src is not null and dst is not null",
    "n17_joined_results": """with r as (select context_id, count(*) as n from vertices where list_contains(labels, 'Alias') group by context_id)
select v.id as l_id, v.context_id as l_context_id, r.context_id as r_context_id, r.n as r_n from vertices v join r on r.context_id is not distinct from v.context_id where list_contains(v.labels, 'Session')""",
    "a01_grouped": "select c_mktsegment as segment, o_orderstatus as status, count(*) as n, round(sum(o_totalprice), 2) as whole, round(avg(o_totalprice), 4) as mean from customer join orders on o_custkey = c_custkey group by all",
    "a02_empty": "select count(*) as n, count(active) as known, coalesce(sum(active::bigint), 0)::bigint as whole from vertices where list_contains(labels, 'NoSuchLabel')",
    "a03_count_present": "select context_id, count(*) as n, count(active) as known from vertices where list_contains(labels, 'Fact') group by context_id",
    "a06_collected": f"with {EDGES} select e.src as s, string_agg(e.dst::varchar, ',' order by e.dst::varchar) as turns from edges e join vertices v on v.id = e.src where e.edge_type = 'HAS_TURN' and list_contains(v.labels, 'Session') group by e.src",
    "a07_pair_counts": "select src, dst, count(*) as n from edge_mutations where edge_type = 'STATED_BY' and src is not null and dst is not null group by all",
    "flagship": f"with {TYPED} select c.id as c, count(*) as n from nodes c join links l on l.edge_type = 'PLACED' and l.src = c.id join nodes o on o.id = l.dst where c.label = 'Customer' and o.amount > 50000 group by c.id order by n desc, c limit 10",
    "u01_union_all": "select id from vertices where list_contains(labels, 'Fact') union all (select id from vertices where list_contains(labels, 'Entity') order by id limit 100)",
    "u02_union": f"with {EDGES} select e.dst as id from edges e join vertices v on v.id = e.src and list_contains(v.labels, 'Fact') where e.edge_type = 'ABOUT' union select id from vertices where list_contains(labels, 'Entity')",
}
