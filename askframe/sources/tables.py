"""Parquet folders of the example schema, and the catalog of it with keys and aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from askframe.sources.catalog import Catalog, ForeignKey

STAR_SCHEMA = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

_TABLE_ALIASES = {
    "customer": ("customers", "client", "clients", "buyer", "buyers"),
    "orders": ("order", "purchase", "purchases", "sale", "sales"),
    "lineitem": ("line items", "line item", "items"),
    "part": ("parts", "product", "products"),
    "supplier": ("suppliers", "vendor", "vendors"),
    "nation": ("nations", "country", "countries"),
    "region": ("regions",),
    "events": ("event", "activity"),
}
_COLUMN_ALIASES = {
    "customer": {"c_custkey": ("customer id", "id"), "c_name": ("name", "customer name"), "c_acctbal": ("balance", "account balance"), "c_mktsegment": ("segment", "market segment")},
    "orders": {
        "o_orderkey": ("order id", "id"),
        "o_custkey": ("customer", "customer id"),
        "o_totalprice": ("amount", "order amount", "revenue", "sales", "spending", "total price", "price"),
        "o_orderdate": ("date", "order date"),
        "o_orderstatus": ("status",),
        "o_orderpriority": ("priority",),
    },
    "lineitem": {"l_quantity": ("quantity",), "l_extendedprice": ("price", "extended price"), "l_shipdate": ("ship date", "date"), "l_returnflag": ("return flag",), "l_linestatus": ("line status",)},
    "part": {"p_partkey": ("part id", "id"), "p_name": ("name", "part name"), "p_brand": ("brand",), "p_type": ("type",), "p_size": ("size",), "p_retailprice": ("price", "retail price")},
    "supplier": {"s_suppkey": ("supplier id", "id"), "s_name": ("name", "supplier name"), "s_acctbal": ("balance", "account balance")},
    "nation": {"n_name": ("name", "nation name")},
    "region": {"r_name": ("name", "region name")},
    "events": {"event_id": ("event id", "id"), "ts": ("time", "date"), "user_id": ("user", "user id"), "event_type": ("type", "event type"), "value": ("amount",)},
}
_PRIMARY = {
    "region": ("r_regionkey",),
    "nation": ("n_nationkey",),
    "customer": ("c_custkey",),
    "supplier": ("s_suppkey",),
    "part": ("p_partkey",),
    "orders": ("o_orderkey",),
    "lineitem": ("l_orderkey", "l_linenumber"),
    "events": ("event_id",),
}
_FOREIGN = (
    ForeignKey("nation", "n_regionkey", "region", "r_regionkey"),
    ForeignKey("customer", "c_nationkey", "nation", "n_nationkey"),
    ForeignKey("supplier", "s_nationkey", "nation", "n_nationkey"),
    ForeignKey("orders", "o_custkey", "customer", "c_custkey"),
    ForeignKey("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ForeignKey("lineitem", "l_partkey", "part", "p_partkey"),
    ForeignKey("lineitem", "l_suppkey", "supplier", "s_suppkey"),
)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def star_catalog(spark: SparkSession, folder: str, names: tuple[str, ...] = STAR_SCHEMA) -> Catalog:
    """The catalog of a Parquet folder. Part names are compared loosely, as addresses are."""
    frames = {n: read_table(spark, folder, n) for n in names}
    keys = [k for k in _FOREIGN if k.table in frames and k.referenced_table in frames]
    return Catalog.from_frames(frames, _TABLE_ALIASES, _COLUMN_ALIASES, _PRIMARY, keys, loose=[("part", "p_name")])
