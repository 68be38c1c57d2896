"""Pattern matching as joins.

A Match holds one row for each binding of the pattern so far: a column for each node's id and for each relationship's
endpoints. Steps add joins; Catalyst and adaptive execution choose their order and kind. Relationships may repeat
(matching is homomorphic). Properties are joined when they are asked for, so only needed columns are read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.predicates import equal
from graphloom.operators.traverse import walks_from
from graphloom.sources.graph import Graph


class Match:
    """An immutable pattern over one graph; every step returns a new one."""

    def __init__(self, graph: Graph, rows: DataFrame | None = None, nodes: frozenset = frozenset(), loaded: frozenset = frozenset(), labels: dict[str, tuple] | None = None):
        self.graph, self.rows, self.nodes, self.loaded, self.labels = graph, rows, nodes, loaded, labels or {}

    def _with(self, rows: DataFrame, *nodes: str, labels: dict[str, tuple] | None = None) -> Match:
        return Match(self.graph, rows, self.nodes | set(nodes), self.loaded, {**self.labels, **(labels or {})})

    def _vertices(self, labels: tuple[str, ...], properties: dict[str, object]) -> DataFrame:
        found = self.graph.vertices
        for label in labels:
            found = found.where(F.array_contains("labels", label))
        for name, value in properties.items():
            found = found.where(equal(F.col(name), F.lit(value), found))
        return found

    def node(self, name: str, /, *labels: str, **properties: object) -> Match:
        """Bind or further restrict a node. A pattern without label or property is refused as a full scan.

        A new node that shares nothing with the rows so far would be a product and is refused as well.
        """
        if not labels and not properties:
            raise ValueError("a node pattern needs a label or a property")
        ids = self._vertices(labels, properties).select(F.col("id").alias(name))
        known = {name: (*self.labels.get(name, ()), *labels)}
        if self.rows is None:
            return self._with(ids, name, labels=known)
        if name not in self.nodes:
            raise ValueError(f"{name} is not connected to the pattern; use product() with a side of known size")
        return self._with(self.rows.join(ids, name, "left_semi"), name, labels=known)

    def ids(self, name: str, ids: DataFrame) -> Match:
        """Bind a node to given ids (column `id`) without checking that they exist."""
        given = ids.select(F.col("id").alias(name))
        return self._with(given if self.rows is None else self.rows.join(given.distinct(), name, "left_semi"), name)

    def expand(
        self,
        src: str,
        edge_type: str,
        dst: str,
        rel: str | None = None,
        incoming: bool = False,
        parallel: bool = False,
        **properties: object,
    ) -> Match:
        """Follow edges of one type from a bound node; if both ends are bound, keep rows that have the edge.

        parallel: one row for each relationship record, and one for the edge itself where it has none. rel: keeps the
        records' other columns as `rel.column`. Properties restrict the edge or record.
        """
        if edge_type is None:
            raise ValueError("exactly one relationship type is needed")
        edges = (parallel_edges(self.graph) if parallel else self.graph.edges).where(F.col("edge_type") == edge_type)
        for name, value in properties.items():
            edges = edges.where(equal(F.col(name), F.lit(value), edges))
        a, b = ("dst", "src") if incoming else ("src", "dst")
        kept = [F.col(a).alias(src), F.col(b).alias(dst)]
        if rel:
            kept += [F.col(c).alias(f"{rel}.{c}") for c in edges.columns if c not in ("src", "dst")]
        step = edges.select(*kept)
        if self.rows is None:
            return self._with(step, src, dst)
        shared = [n for n in (src, dst) if n in self.nodes]
        if not shared:
            raise ValueError("the pattern is not connected; use product() with a side of known size")
        return self._with(self.rows.join(step, shared), src, dst)

    def reach(self, src: str, edge_type: str, dst: str, low: int = 1, high: int = 1) -> Match:
        """Variable-length step: nodes on walks of low to high edges, each once for a source."""
        starts = self.rows.select(F.col(src).alias("root")).distinct()
        found = walks_from(starts, self.graph.edges, edge_type, low, high).select(F.col("root").alias(src), F.col("v").alias(dst))
        shared = [n for n in (src, dst) if n in self.nodes]
        return self._with(self.rows.join(found, shared), src, dst)

    def product(self, other: Match, most: int = 10_000) -> Match:
        """All pairs with a second, unconnected pattern of at most `most` rows, which is checked before it is broadcast."""
        small = other.rows.limit(most + 1)
        if small.count() > most:
            raise ValueError(f"the second pattern has more than {most} rows; connect the patterns instead")
        return Match(self.graph, self.rows.crossJoin(F.broadcast(small)), self.nodes | other.nodes, self.loaded | other.loaded, {**other.labels, **self.labels})

    def join(self, other: Match) -> Match:
        """Natural join of two patterns on the nodes they share."""
        shared = sorted(self.nodes & other.nodes)
        if not shared:
            raise ValueError("the patterns share no node")
        return Match(self.graph, self.rows.join(other.rows, shared), self.nodes | other.nodes, self.loaded, {n: (*self.labels.get(n, ()), *other.labels.get(n, ())) for n in {*self.labels, *other.labels}})

    def optional(self, step: Callable[[Match], Match]) -> Match:
        """Outer step: rows for which `step` (with its own conditions) finds nothing stay, with nulls for what it binds."""
        bound = sorted(self.nodes)
        found = step(Match(self.graph, self.rows.select(*bound).distinct(), self.nodes, labels=self.labels))
        fresh = [c for c in found.rows.columns if c not in bound]
        other = found.rows.select(*[F.col(f"`{c}`").alias(f"_k_{c}") for c in bound], *[F.col(f"`{c}`") for c in fresh])
        on = reduce(lambda x, y: x & y, [self.rows[c].eqNullSafe(other[f"_k_{c}"]) for c in bound])
        rows = self.rows.join(other, on, "left").drop(*[f"_k_{c}" for c in bound])
        return Match(self.graph, rows, self.nodes | found.nodes, self.loaded, self.labels)

    def load(self, name: str, /, *properties: str) -> Match:
        """Join vertex properties as columns `name.property`; null where the vertex or property is missing."""
        missing = [p for p in properties if f"{name}.{p}" not in self.loaded]
        if not missing:
            return self
        # Where the node's labels are known, only their vertices are read; the node has them, so none is lost.
        columns = self._vertices(self.labels.get(name, ()), {}).select(F.col("id").alias(name), *[F.col(p).alias(f"{name}.{p}") for p in missing])
        rows = self.rows.join(columns, name, "left")
        return Match(self.graph, rows, self.nodes, self.loaded | {f"{name}.{p}" for p in missing}, self.labels)

    def where(self, condition: Column) -> Match:
        """Keep rows for which a two-valued condition holds (a null condition counts as false)."""
        return self._with(self.rows.where(F.coalesce(condition, F.lit(False))))

    def returns(self, distinct: bool = False, **columns: Column | str) -> DataFrame:
        """The projection; strings name nodes or loaded properties."""
        rows = self.rows.select(*[(F.col(f"`{c}`") if isinstance(c, str) else c).alias(n) for n, c in columns.items()])
        return rows.distinct() if distinct else rows

    def grouped(self, keys: dict[str, str], **aggregates: Column) -> DataFrame:
        """Implicit grouping: keys (null is one) and aggregates; without keys always one row."""
        named = [F.col(f"`{c}`").alias(n) for n, c in keys.items()]
        return self.rows.groupBy(*named).agg(*[a.alias(n) for n, a in aggregates.items()])


def prop(name: str, property: str) -> Column:
    return F.col(f"`{name}.{property}`")


def parallel_edges(graph: Graph) -> DataFrame:
    """Relationship records, and edges that have none as one row with nulls.

    An edge with properties of its own is a row besides its records; edges that only consist of their ends are not.
    """
    records = graph.relationships
    if records is None:
        return graph.edges
    own = [c for c in graph.edges.columns if c not in ("edge_type", "src", "dst")]
    keys = records.select("edge_type", "src", "dst").distinct()
    bare = graph.edges.join(keys, ["edge_type", "src", "dst"], "left_anti")
    extra = bare
    if own:
        has = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in own])
        extra = bare.unionByName(graph.edges.where(has).join(keys, ["edge_type", "src", "dst"], "left_semi"))
    return records.unionByName(extra, allowMissingColumns=True)


def total(column: Column) -> Column:
    """Sum that is 0 over nothing."""
    return F.coalesce(F.sum(column), F.lit(0))


def collected(column: Column) -> Column:
    """Present values as a sorted list, empty over nothing; meant for groups of bounded size."""
    return F.array_sort(F.collect_list(column))


def window(df: DataFrame, order: list[Column], skip: int = 0, limit: int | None = None) -> DataFrame:
    """ORDER BY, SKIP and LIMIT. Nulls come last ascending and first descending when the caller's columns say so."""
    if skip < 0 or (limit is not None and limit < 0):
        raise ValueError("skip and limit must not be negative")
    out = df.orderBy(*order)
    if skip:
        out = out.offset(skip)
    return out if limit is None else out.limit(limit)


def page(df: DataFrame, order: list[Column], cursor: int, size: int) -> tuple[list, int | None]:
    """Rows of one page and the next cursor, from a look-ahead of one row over a deterministic order."""
    rows = window(df, order, cursor, size + 1).collect()
    return rows[:size], cursor + size if len(rows) > size else None


def union(*arms: DataFrame, all: bool = False) -> DataFrame:
    """UNION of arms with equal column names; each arm keeps its own order and limit."""
    names = arms[0].columns
    if any(a.columns != names for a in arms):
        raise ValueError("all arms need the same columns")
    rows = reduce(DataFrame.unionByName, arms)
    return rows if all else rows.distinct()


def joined_results(left: DataFrame, right: DataFrame, key: str, names: tuple[str, str]) -> DataFrame:
    """Inner join of two result sets on one column with prefixed names; a null key matches a null key."""
    a = left.select(*[F.col(c).alias(f"{names[0]}.{c}") for c in left.columns])
    b = right.select(*[F.col(c).alias(f"{names[1]}.{c}") for c in right.columns])
    return a.join(b, F.col(f"`{names[0]}.{key}`").eqNullSafe(F.col(f"`{names[1]}.{key}`")))


def limited(df: DataFrame, most: int) -> DataFrame:
    """df, or an error where it has more rows than allowed; never a silent cut."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"the result has more than {most} rows")
    return df
