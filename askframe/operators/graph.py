"""The schema graph: tables, columns and concepts as nodes, as DataFrames and on the driver."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askframe.sources.catalog import Catalog

# The weights of the kinds of edges.
WEIGHTS = {"BELONGS_TO": 1.0, "FOREIGN_KEY": 1.0, "SEMANTIC_ALIAS": 0.8, "SIMILAR_TO": 0.5}
DEPTH = 2


@dataclass(frozen=True)
class Node:
    key: str
    kind: str
    label: str
    dataset_id: str = ""
    table: str = ""
    column: str = ""


@dataclass(frozen=True)
class Edge:
    source: str
    target: str
    kind: str
    weight: float


@dataclass
class SchemaGraph:
    """Nodes by key and edges in both directions."""

    nodes: dict[str, Node] = field(default_factory=dict)
    edges: list[Edge] = field(default_factory=list)

    def add(self, a: Node, b: Node, kind: str) -> None:
        for node in (a, b):
            self.nodes.setdefault(node.key, node)
        self.edges += [Edge(a.key, b.key, kind, WEIGHTS[kind]), Edge(b.key, a.key, kind, WEIGHTS[kind])]

    @classmethod
    def of(cls, catalogs: dict[str, Catalog]) -> SchemaGraph:
        """Belongings, aliases and keys of each dataset, and similar columns across all of them."""
        graph = cls()
        columns = []
        for dataset, catalog in catalogs.items():
            home = Node(dataset, "dataset", dataset, dataset)
            for table in catalog.tables.values():
                t = Node(f"{dataset}.{table.name}", "table", table.name, dataset, table.name)
                graph.add(t, home, "BELONGS_TO")
                for info in table.columns.values():
                    c = Node(f"{t.key}.{info.name}", "column", info.name, dataset, table.name, info.name)
                    graph.add(c, t, "BELONGS_TO")
                    columns.append(c)
                    for alias in info.aliases:
                        if alias not in (info.name, info.name.replace("_", " ")):
                            graph.add(Node(f"concept:{alias.lower()}", "concept", alias.lower()), c, "SEMANTIC_ALIAS")
            for k in catalog.foreign_keys:
                ends = [graph.nodes[f"{dataset}.{t}.{c}"] for t, c in ((k.table, k.column), (k.referenced_table, k.referenced_column))]
                graph.add(*ends, "FOREIGN_KEY")
        by_name: dict[str, list[Node]] = {}
        for c in columns:
            for name in {c.column, c.column.removesuffix("_id")}:
                by_name.setdefault(name, []).append(c)
        pairs = {tuple(sorted((a.key, b.key))) for same in by_name.values() for a, b in combinations(same, 2) if a.table != b.table or a.dataset_id != b.dataset_id}
        for a, b in sorted(pairs):
            graph.add(graph.nodes[a], graph.nodes[b], "SIMILAR_TO")
        return graph

    def expand(self, seeds: Iterable[str], max_depth: int = DEPTH, kinds: Sequence[str] | None = None) -> dict[str, int]:
        """Keys within ``max_depth`` hops of the seeds, with their distance."""
        depth = {s: 0 for s in seeds if s in self.nodes}
        frontier = set(depth)
        for d in range(1, max_depth + 1):
            frontier = {e.target for e in self.edges if e.source in frontier and (kinds is None or e.kind in kinds)} - depth.keys()
            depth |= dict.fromkeys(frontier, d)
        return depth

    def undirected(self) -> list[Edge]:
        """Each edge once."""
        return [e for e in self.edges if e.source < e.target]

    def frames(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        nodes = spark.createDataFrame([vars(n) for n in self.nodes.values()], "key string, kind string, label string, dataset_id string, table string, column string")
        return nodes, spark.createDataFrame([vars(e) for e in self.edges], "source string, target string, kind string, weight double")


def both_ways(edges: DataFrame) -> DataFrame:
    """Edges (source, target, ...) and the same turned round."""
    turned = edges.select(*[F.col({"source": "target", "target": "source"}.get(c, c)).alias(c) for c in edges.columns])
    return edges.unionByName(turned).distinct()


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int = DEPTH) -> DataFrame:
    """``node`` and ``depth`` for all nodes within ``max_depth`` hops of ``seeds`` (column node), along (source, target).

    Each round joins only the nodes that the round before has found first.
    """
    found = seeds.select("node").distinct().withColumn("depth", F.lit(0).cast("bigint"))
    frontier = found
    for d in range(1, max_depth + 1):
        steps = edges.join(frontier.select(F.col("node").alias("source")), "source").select(F.col("target").alias("node")).distinct()
        frontier = steps.join(found, "node", "left_anti").withColumn("depth", F.lit(d).cast("bigint"))
        found = found.unionByName(frontier)
    return found


def similar_pairs(df: DataFrame, by: str, order: str, name: str) -> DataFrame:
    """Pairs of rows that share ``by``, each once by ``order``: for metadata, whose groups are small."""
    a = df.select(F.col(by).alias("k"), F.col(order).alias("ia"), F.col(name).alias("left_name"))
    b = df.select(F.col(by).alias("k"), F.col(order).alias("ib"), F.col(name).alias("right_name"))
    return a.join(b, "k").where("ia < ib").select("left_name", "right_name")
