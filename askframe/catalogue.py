"""The registered queries: each builds its DataFrame through the plan algebra or the operator that it is named after."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askframe.engine import Engine
from askframe.functions.vectors import bucket, sign
from askframe.operators import compare, graph, journal, profile
from askframe.operators.joinpath import find_path
from askframe.plans.guard import capped
from askframe.plans.lower import lower
from askframe.plans.model import Aggregate, Column, Compare, Condition, Cte, DateRange, Having, Join, Plan, Sort, Subquery, WindowCall
from askframe.plans.model import plan_from_json as decoded
from askframe.retrieval import lexical, vector
from askframe.sources.csv_ingest import whole
from askframe.sources.tables import read_table, star_catalog

Query = Callable[[SparkSession, str], DataFrame]


def _cols(names: str) -> tuple[Column, ...]:
    return tuple(Column(n) for n in names.split())


def _leaf(column: str, operator: str, value: Any = None) -> Condition:
    return Condition("predicate", Compare(column, operator, value))


def _asc(*names: str) -> tuple[Sort, ...]:
    return tuple(Sort(n) for n in names)


def planned(plan: Plan) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return lower(plan, star_catalog(spark, sf_dir))

    return run


def rounded(plan: Plan, **digits: int) -> Query:
    """The plan's rows with some columns rounded, as sums of doubles differ in their last bits from run to run."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = lower(plan, star_catalog(spark, sf_dir))
        return df.select(*[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns])

    return run


_ORDER_SEQUENCE = (Sort("o_orderdate"), Sort("o_orderkey"))
_LINES = {"partition_by": ("l_orderkey",), "order_by": _asc("l_linenumber")}

PLANS: dict[str, Plan] = {
    "scan_project": Plan("orders", select=_cols("o_orderkey o_custkey")),
    "filter_gt": Plan("orders", select=_cols("o_orderkey o_totalprice"), filters=(Compare("o_totalprice", ">", 450000),)),
    "filter_conjunction": Plan("part", select=_cols("p_partkey"), filters=(Compare("p_size", ">=", 40), Compare("p_retailprice", "<", 950))),
    "filter_string_ci": Plan("customer", select=_cols("c_custkey"), filters=(Compare("c_mktsegment", "=", "building"),)),
    "filter_string_ne": Plan("customer", select=_cols("c_custkey"), filters=(Compare("c_mktsegment", "!=", "building"),)),
    "filter_text_normalized": Plan("part", select=_cols("p_partkey"), filters=(Compare("p_name", "=", "red,  widget"),)),
    "filter_like": Plan("part", select=_cols("p_partkey p_name"), filters=(Compare("p_name", "LIKE", "%RING"),)),
    "filter_not_like": Plan("part", select=_cols("p_partkey p_name"), filters=(Compare("p_name", "NOT LIKE", "%ring"),)),
    "filter_between": Plan("orders", select=_cols("o_orderkey"), filters=(Compare("o_totalprice", "BETWEEN", (100000, 200000)),)),
    "filter_in_list": Plan("orders", select=_cols("o_orderkey"), filters=(Compare("o_orderpriority", "IN", ("1-URGENT", "5-LOW")),)),
    "filter_not_in_list": Plan("orders", select=_cols("o_orderkey"), filters=(Compare("o_orderstatus", "NOT IN", ("F", "P")),)),
    "filter_is_null_after_left_join": Plan(
        "customer", joins=(Join("supplier", "c_custkey", "s_suppkey", "LEFT"),), select=_cols("c_custkey s_suppkey"), filters=(Compare("s_suppkey", "IS NULL"),)
    ),
    "filter_is_not_null": Plan("events", select=_cols("event_id"), filters=(Compare("value", "IS NOT NULL"),)),
    "filter_tree_or_not": Plan(
        "orders",
        select=_cols("o_orderkey"),
        where=Condition(
            "or",
            children=(
                Condition("and", children=(_leaf("o_totalprice", ">", 400000), _leaf("o_orderstatus", "=", "f"))),
                Condition("not", children=(_leaf("o_totalprice", ">=", 2000),)),
            ),
        ),
    ),
    "filter_date_range": Plan("orders", select=_cols("o_orderkey o_orderdate"), filters=(DateRange("o_orderdate", date(1998, 1, 1), date(1998, 2, 1)),)),
    "filter_date_after": Plan("orders", select=_cols("o_orderkey"), filters=(DateRange("o_orderdate", date(2000, 1, 2), date.max),)),
    "in_subquery": Plan(
        "orders", select=_cols("o_orderkey"), filters=(Compare("o_custkey", "IN", Subquery(Plan("customer", select=_cols("c_custkey"), filters=(Compare("c_acctbal", ">", 9000),)))),)
    ),
    "not_in_subquery": Plan(
        "orders", select=_cols("o_orderkey"), filters=(Compare("o_custkey", "NOT IN", Subquery(Plan("customer", select=_cols("c_custkey"), filters=(Compare("c_acctbal", ">", 0),)))),)
    ),
    "exists_subquery": Plan(
        "region", select=_cols("r_regionkey r_name"), filters=(Compare("r_regionkey", "EXISTS", Subquery(Plan("nation", select=_cols("n_nationkey"), filters=(Compare("n_nationkey", "=", 3),)))),)
    ),
    "join_inner": Plan("orders", joins=(Join("customer", "o_custkey", "c_custkey"),), select=_cols("o_orderkey c_name"), filters=(Compare("o_totalprice", ">", 400000),)),
    "join_left": Plan("part", joins=(Join("lineitem", "p_partkey", "l_partkey", "LEFT"),), select=_cols("p_partkey l_orderkey"), filters=(Compare("p_size", "=", 1),)),
    "join_right": Plan("supplier", joins=(Join("nation", "s_nationkey", "n_nationkey", "RIGHT"),), select=_cols("n_name s_suppkey")),
    "join_full": Plan("supplier", joins=(Join("customer", "s_suppkey", "c_custkey", "FULL"),), select=_cols("s_suppkey c_custkey")),
    "distinct_project": Plan("orders", distinct=True, select=_cols("o_orderstatus o_orderpriority")),
    "agg_count_distinct": Plan("orders", aggregations=(Aggregate("COUNT", "o_custkey", "customers", True),)),
    "agg_sum_distinct": Plan("part", aggregations=(Aggregate("SUM", "p_size", "s", True),)),
    "agg_group_by": Plan("orders", select=_cols("o_custkey"), aggregations=(Aggregate("COUNT", "o_orderkey", "n"),), group_by=("o_custkey",)),
    "agg_group_hidden_key": Plan("orders", aggregations=(Aggregate("COUNT", "o_orderkey", "n"),), group_by=("o_orderpriority",)),
    "agg_having_unselected": Plan("orders", select=_cols("o_custkey"), group_by=("o_custkey",), having=(Having(Aggregate("COUNT", "o_orderkey"), ">=", 15),)),
    "topk_rows": Plan("orders", select=_cols("o_orderkey o_totalprice"), order_by=(Sort("o_totalprice", "DESC"), Sort("o_orderkey")), limit=10),
    "bottomk_rows": Plan("orders", select=_cols("o_orderkey o_totalprice"), order_by=_asc("o_totalprice", "o_orderkey"), limit=10),
    "window_row_number": Plan("orders", select=(Column("o_orderkey"), WindowCall("ROW_NUMBER", "*", ("o_custkey",), _ORDER_SEQUENCE, "rn"))),
    "window_rank_dense_rank": Plan(
        "part",
        select=(
            Column("p_partkey"),
            WindowCall("RANK", "*", ("p_brand",), (Sort("p_size", "DESC"),), "rk"),
            WindowCall("DENSE_RANK", "*", ("p_brand",), (Sort("p_size", "DESC"),), "drk"),
        ),
    ),
    "window_lag_lead": Plan(
        "orders",
        select=(
            Column("o_orderkey"),
            WindowCall("LAG", "o_totalprice", ("o_custkey",), _ORDER_SEQUENCE, "prev_price"),
            WindowCall("LEAD", "o_totalprice", ("o_custkey",), _ORDER_SEQUENCE, "next_price"),
        ),
    ),
    "window_running_aggs": Plan(
        "lineitem",
        select=(
            *_cols("l_orderkey l_linenumber"),
            *(WindowCall(f, "l_quantity", alias=a, **_LINES) for f, a in (("SUM", "s"), ("AVG", "a"), ("MIN", "lo"), ("MAX", "hi"))),
            WindowCall("COUNT", "*", alias="n", **_LINES),
        ),
    ),
    "window_partition_total": Plan("orders", select=(Column("o_orderkey"), WindowCall("COUNT", "*", ("o_custkey",), alias="n"))),
    "cte_filter": Plan(
        "big",
        ctes=(Cte("big", Plan("orders", select=_cols("o_orderkey o_totalprice"), filters=(Compare("o_totalprice", ">", 400000),)), ("k", "price")),),
        select=_cols("k price"),
        filters=(Compare("price", "<", 450000),),
    ),
    "cte_window_top1": Plan(
        "r",
        ctes=(
            Cte("r", Plan("orders", select=(*_cols("o_custkey o_orderkey"), WindowCall("ROW_NUMBER", "*", ("o_custkey",), (Sort("o_totalprice", "DESC"), Sort("o_orderkey")), "rn")))),
        ),
        select=_cols("o_custkey o_orderkey"),
        filters=(Compare("rn", "=", 1),),
    ),
}
ROUNDED: dict[str, tuple[Plan, dict[str, int]]] = {
    "agg_global_all": (
        Plan(
            "orders",
            aggregations=(
                Aggregate("COUNT", "o_orderkey", "n"),
                Aggregate("COUNT", "*", "n_all"),
                *(Aggregate(f, "o_totalprice", a) for f, a in (("SUM", "total"), ("AVG", "average"), ("MIN", "lo"), ("MAX", "hi"))),
            ),
        ),
        {"total": 2, "average": 4},
    ),
    "agg_group_by_two_keys": (
        Plan("lineitem", select=_cols("l_returnflag l_linestatus"), aggregations=(Aggregate("SUM", "l_quantity", "qty"),), group_by=("l_returnflag", "l_linestatus")),
        {"qty": 2},
    ),
    "agg_having": (
        Plan(
            "orders",
            select=_cols("o_custkey"),
            aggregations=(Aggregate("SUM", "o_totalprice", "total"),),
            group_by=("o_custkey",),
            having=(Having(Aggregate("SUM", "o_totalprice"), ">", 3000000),),
        ),
        {"total": 2},
    ),
    "agg_topk_by_aggregate": (
        Plan(
            "orders",
            select=_cols("o_custkey"),
            aggregations=(Aggregate("SUM", "o_totalprice", "total"),),
            group_by=("o_custkey",),
            order_by=(Sort(direction="DESC", aggregation=Aggregate("SUM", "o_totalprice")), Sort("o_custkey")),
            limit=5,
        ),
        {"total": 2},
    ),
    "cte_aggregate_join": (
        Plan(
            "spend",
            ctes=(
                Cte("spend", Plan("orders", select=_cols("o_custkey"), aggregations=(Aggregate("SUM", "o_totalprice", "total"),), group_by=("o_custkey",)), ("cust", "total")),
            ),
            joins=(Join("customer", "cust", "c_custkey"),),
            select=_cols("c_name total"),
            filters=(Compare("total", ">", 3000000),),
        ),
        {"total": 2},
    ),
}


def join_path_multi_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = star_catalog(spark, sf_dir)
    path = find_path(catalog, "orders", "region")
    assert path is not None
    return lower(Plan("orders", joins=path.joins, select=_cols("r_name"), aggregations=(Aggregate("COUNT", "o_orderkey", "n"),), group_by=("r_name",)), catalog)


#: A plan as decoded JSON, with names qualified by their tables.
JSON_PLAN: dict[str, Any] = {
    "source": "orders",
    "joins": [{"table": "customer", "left_column": "o_custkey", "right_column": "c_custkey"}],
    "select": [{"name": "orders.o_orderkey"}, {"name": "customer.c_name"}],
    "filters": [{"column": "o_totalprice", "operator": ">", "value": 440000}, {"column": "o_orderstatus", "operator": "in", "value": ["O", "F"]}],
}


def plan_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lower(decoded(JSON_PLAN), star_catalog(spark, sf_dir))


def guarded_row_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = lower(Plan("orders", select=_cols("o_orderkey"), order_by=_asc("o_orderkey")), star_catalog(spark, sf_dir))
    return capped(df, max_rows=500)


def profile_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.profile(read_table(spark, sf_dir, "orders"), ["o_orderstatus", "o_custkey"]).drop("null_ratio")


def null_ratio_after_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = lower(Plan("customer", joins=(Join("supplier", "c_custkey", "s_suppkey", "LEFT"),), select=_cols("c_custkey s_suppkey")), star_catalog(spark, sf_dir))
    return profile.profile(df, ["s_suppkey"]).select("null_ratio")


def percentile_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.nearest_rank(read_table(spark, sf_dir, "events"), "value", [0.5, 0.95], ["p50", "p95"])


def lexical_overlap_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read_table(spark, sf_dir, "documents"), "doc_id", "text", "the quick data engine", 20)


def _query_vector(df: DataFrame) -> Any:
    return df.where("vec_id = 0").select("embedding").limit(1).scalar()


def vector_topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read_table(spark, sf_dir, "embeddings")
    return vector.search(df, "vec_id", "embedding", _query_vector(df), 10).select("vec_id", F.round("score", 6).alias("score"))


def vector_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read_table(spark, sf_dir, "embeddings")
    return vector.margin(df.where("vec_id != 0"), "vec_id", "embedding", _query_vector(df))


def hash_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = read_table(spark, sf_dir, "events").select("event_type").distinct()
    return kinds.select("event_type", bucket(F.col("event_type")).alias("bucket"), sign(F.col("event_type")).alias("sign"))


def workload_shift_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events")
    return profile.shift_distance(events, events.orderBy(F.desc("event_id")).limit(50), "event_type")


def conversation_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.conversation_window(read_table(spark, sf_dir, "conversations")).select("conv_id", "turn", "role")


def feedback_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events")
    return journal.priors(events, ["user_id"], "event_id", F.col("event_type") != "error", F.col("value"))


def label_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.label_report(read_table(spark, sf_dir, "labels"), "quality", F.col("toxic") == 0)


def graph_bfs_depth2(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read_table(spark, sf_dir, "nation")
    edges = nation.select(F.concat(F.lit("n"), "n_nationkey").alias("source"), F.concat(F.lit("r"), "n_regionkey").alias("target"))
    return graph.reach(graph.both_ways(edges), spark.createDataFrame([("n0",)], "node string"))


def similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.similar_pairs(read_table(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey", "n_name")


def result_set_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = star_catalog(spark, sf_dir)
    above = lambda price: lower(Plan("orders", select=_cols("o_custkey"), filters=(Compare("o_totalprice", ">", price),)), catalog)
    return compare.difference(above(300000), above(400000))


def clean_typed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders")
    dirty = F.concat(F.lit("$"), F.format_number(F.rint("o_totalprice"), 0))
    return orders.select("o_orderkey", whole(dirty).alias("amount"))


OPERATORS: dict[str, Query] = {
    f.__name__: f
    for f in (
        join_path_multi_hop, plan_from_json, guarded_row_cap, profile_orders, null_ratio_after_left_join, percentile_nearest_rank, lexical_overlap_topk,
        vector_topk_cosine, vector_margin, hash_bucket, workload_shift_distance, conversation_window, feedback_prior, label_report,
        graph_bfs_depth2, similar_pairs, result_set_diff, clean_typed_columns,
    )
}


#: English questions, the columns of their answers that are rounded, and to how many digits.
QUESTIONS: dict[str, tuple[str, dict[str, int]]] = {
    "nl_orders_above": ("show orders with amount above 450000", {}),
    "nl_how_many_orders": ("how many orders are there", {}),
    "nl_average_order_amount": ("average order amount", {"avg_o_totalprice": 4}),
    "nl_revenue_this_year": ("total revenue this year", {"sum_o_totalprice": 2}),
    "nl_orders_per_status": ("count orders per status", {}),
    "nl_revenue_by_month": ("total revenue by month", {"sum_o_totalprice": 2}),
    "nl_parts_by_size_and_price": ("show parts with size at least 45 and retail price less than 1000", {}),
    "nl_customers_of_segment": ("show customers where segment is building", {}),
    "nl_customers_who_spent": ("show customers who spent more than 3 million", {"total_purchase": 2}),
    "nl_orders_last_month": ("show orders from last month", {}),
    "nl_sales_per_priority": ("sales per priority", {"sum_o_totalprice": 2}),
    "nl_orders_last_days": ("show orders from the last 7 days", {}),
    "nl_orders_last_week": ("show orders from last week", {}),
    "nl_orders_last_year": ("show orders from last year", {}),
    "nl_orders_between_days": ("show orders between january 1 1998 and january 31 1998", {}),
    "nl_orders_after_day": ("show orders after march 1", {}),
    "nl_orders_before_day": ("show orders before 1995-01-05", {}),
}
#: The day on which the questions are asked.
ASKED_ON = date(1998, 6, 15)


def asked(question: str, digits: dict[str, int]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        answer = (engine := Engine(star_catalog(spark, sf_dir), today=ASKED_ON)).parse(question)
        if answer.plan is None or not answer.success:
            raise answer.error or ValueError(question)
        df = engine.dataframe(answer.plan)
        kinds = dict(df.dtypes)
        # days as text, which every reader shows alike
        shown = lambda c: F.col(c).cast("string").alias(c) if kinds[c] == "date" else F.col(c)
        return df.select(*[F.round(c, digits[c]).alias(c) if c in digits else shown(c) for c in df.columns])

    return run


def queries() -> dict[str, Query]:
    spoken = {n: asked(q, d) for n, (q, d) in QUESTIONS.items()}
    return spoken | {n: planned(p) for n, p in PLANS.items()} | {n: rounded(p, **d) for n, (p, d) in ROUNDED.items()} | OPERATORS


ORACLE: dict[str, str] = {
    "scan_project": """SELECT o_orderkey, o_custkey FROM orders""",
    "filter_gt": """SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 450000""",
    "filter_conjunction": """SELECT p_partkey FROM part WHERE p_size >= 40 AND p_retailprice < 950""",
    "filter_string_ci": """SELECT c_custkey FROM customer WHERE LOWER(c_mktsegment) = LOWER('building')""",
    "filter_string_ne": """SELECT c_custkey FROM customer WHERE LOWER(c_mktsegment) != LOWER('building')""",
    "filter_text_normalized": """SELECT p_partkey FROM part WHERE LOWER(REPLACE(REPLACE(p_name, ',', ''), '  ', ' ')) = LOWER('red widget')""",
    "filter_like": """SELECT p_partkey, p_name FROM part WHERE LOWER(p_name) LIKE LOWER('%RING')""",
    "filter_not_like": """SELECT p_partkey, p_name FROM part WHERE LOWER(p_name) NOT LIKE LOWER('%ring')""",
    "filter_between": """SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 100000 AND 200000""",
    "filter_in_list": """SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')""",
    "filter_not_in_list": """SELECT o_orderkey FROM orders WHERE o_orderstatus NOT IN ('F', 'P')""",
    "filter_is_null_after_left_join": """SELECT c_custkey, s_suppkey FROM customer LEFT JOIN supplier ON customer.c_custkey = supplier.s_suppkey WHERE s_suppkey IS NULL""",
    "filter_is_not_null": """SELECT event_id FROM events WHERE value IS NOT NULL""",
    "filter_tree_or_not": """SELECT o_orderkey FROM orders WHERE ((o_totalprice > 400000 AND LOWER(o_orderstatus) = 'f') OR NOT (o_totalprice >= 2000))""",
    "filter_date_range": """SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= DATE '1998-01-01' AND o_orderdate < DATE '1998-02-01'""",
    "filter_date_after": """SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '2000-01-02'""",
    "in_subquery": """SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)""",
    "not_in_subquery": """SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""",
    "exists_subquery": """SELECT r_regionkey, r_name FROM region WHERE EXISTS (SELECT n_nationkey FROM nation WHERE n_nationkey = 3)""",
    "join_inner": """SELECT o_orderkey, c_name FROM orders INNER JOIN customer ON orders.o_custkey = customer.c_custkey WHERE o_totalprice > 400000""",
    "join_left": """SELECT p_partkey, l_orderkey FROM part LEFT JOIN lineitem ON part.p_partkey = lineitem.l_partkey WHERE p_size = 1""",
    "join_right": """SELECT n_name, s_suppkey FROM supplier RIGHT JOIN nation ON supplier.s_nationkey = nation.n_nationkey""",
    "join_full": """SELECT s_suppkey, c_custkey FROM supplier FULL JOIN customer ON supplier.s_suppkey = customer.c_custkey""",
    "join_path_multi_hop": """SELECT r_name, COUNT(o_orderkey) AS n FROM orders INNER JOIN customer ON orders.o_custkey = customer.c_custkey INNER JOIN nation ON customer.c_nationkey = nation.n_nationkey INNER JOIN region ON nation.n_regionkey = region.r_regionkey GROUP BY r_name""",
    "distinct_project": """SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders""",
    "agg_global_all": """SELECT COUNT(o_orderkey) AS n, COUNT(*) AS n_all, ROUND(SUM(o_totalprice), 2) AS total, ROUND(AVG(o_totalprice), 4) AS average, MIN(o_totalprice) AS lo, MAX(o_totalprice) AS hi FROM orders""",
    "agg_count_distinct": """SELECT COUNT(DISTINCT o_custkey) AS customers FROM orders""",
    "agg_sum_distinct": """SELECT CAST(SUM(DISTINCT p_size) AS BIGINT) AS s FROM part""",
    "agg_group_by": """SELECT o_custkey, COUNT(o_orderkey) AS n FROM orders GROUP BY o_custkey""",
    "agg_group_by_two_keys": """SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS qty FROM lineitem GROUP BY l_returnflag, l_linestatus""",
    "agg_group_hidden_key": """SELECT COUNT(o_orderkey) AS n FROM orders GROUP BY o_orderpriority""",
    "agg_having": """SELECT o_custkey, ROUND(SUM(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING SUM(o_totalprice) > 3000000""",
    "agg_having_unselected": """SELECT o_custkey FROM orders GROUP BY o_custkey HAVING COUNT(o_orderkey) >= 15""",
    "agg_topk_by_aggregate": """SELECT o_custkey, ROUND(SUM(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey ORDER BY SUM(o_totalprice) DESC, o_custkey ASC LIMIT 5""",
    "topk_rows": """SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey ASC LIMIT 10""",
    "bottomk_rows": """SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice ASC, o_orderkey ASC LIMIT 10""",
    "guarded_row_cap": """SELECT o_orderkey FROM orders ORDER BY o_orderkey ASC LIMIT 100""",
    "window_row_number": """SELECT o_orderkey, CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate ASC, o_orderkey ASC) AS BIGINT) AS rn FROM orders""",
    "window_rank_dense_rank": """SELECT p_partkey, CAST(RANK() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS BIGINT) AS rk, CAST(DENSE_RANK() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS BIGINT) AS drk FROM part""",
    "window_lag_lead": """SELECT o_orderkey, LAG(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate ASC, o_orderkey ASC) AS prev_price, LEAD(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate ASC, o_orderkey ASC) AS next_price FROM orders""",
    "window_running_aggs": """SELECT l_orderkey, l_linenumber, SUM(l_quantity) OVER w AS s, AVG(l_quantity) OVER w AS a, MIN(l_quantity) OVER w AS lo, MAX(l_quantity) OVER w AS hi, COUNT(*) OVER w AS n FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber ASC)""",
    "window_partition_total": """SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_custkey) AS n FROM orders""",
    "cte_filter": """WITH big(k, price) AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 400000) SELECT k, price FROM big WHERE price < 450000""",
    "cte_aggregate_join": """WITH spend(cust, total) AS (SELECT o_custkey, SUM(o_totalprice) FROM orders GROUP BY o_custkey) SELECT c_name, ROUND(total, 2) AS total FROM spend INNER JOIN customer ON spend.cust = customer.c_custkey WHERE total > 3000000""",
    "cte_window_top1": """WITH r AS (SELECT o_custkey, o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey ASC) AS rn FROM orders) SELECT o_custkey, o_orderkey FROM r WHERE rn = 1""",
    "profile_orders": """SELECT 'o_orderstatus' AS column_name, COUNT(*) AS row_count, COUNT(o_orderstatus) AS non_null_count, COUNT(DISTINCT o_orderstatus) AS distinct_count, CAST(MIN(o_orderstatus) AS VARCHAR) AS minimum, CAST(MAX(o_orderstatus) AS VARCHAR) AS maximum FROM orders UNION ALL SELECT 'o_custkey', COUNT(*), COUNT(o_custkey), COUNT(DISTINCT o_custkey), CAST(MIN(o_custkey) AS VARCHAR), CAST(MAX(o_custkey) AS VARCHAR) FROM orders""",
    "null_ratio_after_left_join": """SELECT CAST(ROUND((COUNT(*) - COUNT(s_suppkey)) * 1.0 / COUNT(*), 4) AS DOUBLE) AS null_ratio FROM customer LEFT JOIN supplier ON customer.c_custkey = supplier.s_suppkey""",
    "percentile_nearest_rank": """SELECT p50, p95 FROM (SELECT list_sort(list(value)) AS v FROM events), LATERAL (SELECT v[CAST(round_even((len(v) - 1) * 0.50, 0) AS BIGINT) + 1] AS p50, v[CAST(round_even((len(v) - 1) * 0.95, 0) AS BIGINT) + 1] AS p95)""",
    "lexical_overlap_topk": """WITH q AS (SELECT list_distinct(regexp_extract_all(lower('the quick data engine'), '[a-z0-9_]+')) AS qt), s AS (SELECT doc_id, len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')), qt)) * 1.0 / len(qt) AS score FROM documents, q) SELECT doc_id, score::DOUBLE AS score FROM s WHERE score > 0 ORDER BY score DESC, doc_id ASC LIMIT 20""",
    "vector_topk_cosine": """WITH q AS (SELECT embedding AS qe FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], qe::DOUBLE[]) AS score FROM embeddings, q) SELECT vec_id, ROUND(score, 6) AS score FROM s ORDER BY s.score DESC, vec_id ASC LIMIT 10""",
    "vector_margin": """WITH q AS (SELECT embedding AS qe FROM embeddings WHERE vec_id = 0), s AS (SELECT list_cosine_similarity(embedding::DOUBLE[], qe::DOUBLE[]) AS score FROM embeddings, q WHERE vec_id != 0) SELECT ROUND(max(score) - list_sort(list(score), 'DESC')[2], 6) AS margin FROM s""",
    "hash_bucket": """SELECT event_type, CAST(('0x' || substr(sha256(event_type), 1, 8))::BIGINT % 128 AS BIGINT) AS bucket, CASE WHEN ('0x' || substr(sha256(event_type), 9, 2))::BIGINT % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sign FROM (SELECT DISTINCT event_type FROM events)""",
    "workload_shift_distance": """WITH h AS (SELECT event_type AS k, COUNT(*) * 1.0 / SUM(COUNT(*)) OVER () AS p FROM events GROUP BY 1), r AS (SELECT event_type AS k, COUNT(*) * 1.0 / SUM(COUNT(*)) OVER () AS p FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 50) GROUP BY 1) SELECT ROUND(CAST(SUM(ABS(COALESCE(h.p, 0) - COALESCE(r.p, 0))) / 2 AS DOUBLE), 6) AS distance FROM h FULL JOIN r ON h.k = r.k""",
    "conversation_window": """SELECT conv_id, turn, role FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 12 AND role IN ('user', 'assistant') AND TRIM(text) != ''""",
    "feedback_prior": """SELECT user_id, ROUND(AVG(CASE WHEN event_type = 'error' THEN -value ELSE value END), 6) AS prior FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn <= 20 GROUP BY user_id""",
    "label_report": """SELECT CAST(quality AS BIGINT) AS label, COUNT(*) AS total, COUNT(*) FILTER (WHERE toxic = 0) AS success FROM labels GROUP BY quality""",
    "graph_bfs_depth2": """WITH RECURSIVE e(a, b) AS (SELECT CONCAT('n', n_nationkey), CONCAT('r', n_regionkey) FROM nation UNION ALL SELECT CONCAT('r', n_regionkey), CONCAT('n', n_nationkey) FROM nation), f(node, d) AS (SELECT 'n0', 0 UNION ALL SELECT e.b, f.d + 1 FROM f INNER JOIN e ON e.a = f.node WHERE f.d < 2) SELECT node, CAST(MIN(d) AS BIGINT) AS depth FROM f GROUP BY node""",
    "similar_pairs": """SELECT a.n_name AS left_name, b.n_name AS right_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey""",
    "result_set_diff": """SELECT o_custkey FROM orders WHERE o_totalprice > 300000 EXCEPT ALL SELECT o_custkey FROM orders WHERE o_totalprice > 400000""",
    "clean_typed_columns": """SELECT o_orderkey, CAST(CAST(REPLACE(REPLACE('$' || CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR), '$', ''), ',', '') AS DOUBLE) AS BIGINT) AS amount FROM orders""",
    "nl_orders_above": "SELECT * FROM orders WHERE o_totalprice > 450000",
    "nl_how_many_orders": "SELECT COUNT(o_orderkey) AS count FROM orders",
    "nl_average_order_amount": "SELECT ROUND(AVG(o_totalprice), 4) AS avg_o_totalprice FROM orders",
    "nl_revenue_this_year": "SELECT ROUND(SUM(o_totalprice), 2) AS sum_o_totalprice FROM orders WHERE o_orderdate >= DATE '1998-01-01' AND o_orderdate < DATE '1999-01-01'",
    "nl_orders_per_status": "SELECT o_orderstatus, COUNT(o_orderkey) AS count FROM orders GROUP BY o_orderstatus",
    "nl_revenue_by_month": "SELECT CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR) AS o_orderdate, ROUND(SUM(o_totalprice), 2) AS sum_o_totalprice FROM orders GROUP BY 1",
    "nl_parts_by_size_and_price": "SELECT * FROM part WHERE p_size >= 45 AND p_retailprice < 1000",
    "nl_customers_of_segment": "SELECT * FROM customer WHERE LOWER(c_mktsegment) = 'building'",
    "nl_customers_who_spent": "SELECT o_custkey, ROUND(SUM(o_totalprice), 2) AS total_purchase FROM orders GROUP BY o_custkey HAVING SUM(o_totalprice) > 3000000",
    "nl_orders_last_month": "SELECT * FROM orders WHERE o_orderdate >= DATE '1998-05-01' AND o_orderdate < DATE '1998-06-01'",
    "nl_orders_last_days": "SELECT * FROM orders WHERE o_orderdate >= DATE '1998-06-09' AND o_orderdate < DATE '1998-06-16'",
    "nl_orders_last_week": "SELECT * FROM orders WHERE o_orderdate >= DATE '1998-06-08' AND o_orderdate < DATE '1998-06-15'",
    "nl_orders_last_year": "SELECT * FROM orders WHERE o_orderdate >= DATE '1997-01-01' AND o_orderdate < DATE '1998-01-01'",
    "nl_orders_between_days": "SELECT * FROM orders WHERE o_orderdate >= DATE '1998-01-01' AND o_orderdate < DATE '1998-02-01'",
    "nl_orders_after_day": "SELECT * FROM orders WHERE o_orderdate >= DATE '1998-03-02'",
    "nl_orders_before_day": "SELECT * FROM orders WHERE o_orderdate < DATE '1995-01-05'",
    "plan_from_json": "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 440000 AND o_orderstatus IN ('O', 'F')",
    "nl_sales_per_priority": "SELECT o_orderpriority, ROUND(SUM(o_totalprice), 2) AS sum_o_totalprice FROM orders GROUP BY o_orderpriority",
}
