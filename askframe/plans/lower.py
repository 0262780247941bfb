"""Lowering of a plan to a DataFrame. Nothing runs here: Catalyst gets the whole query."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date, datetime
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askframe.plans.analyzer import Analyzer, Scope, star_columns
from askframe.plans.model import Aggregate, Compare, Condition, DateRange, Plan, Sort, Subquery, WindowCall
from askframe.sources.catalog import Catalog, ColumnInfo, type_tag

_COMPARE = {
    ">": lambda a, b: a > b,
    "<": lambda a, b: a < b,
    ">=": lambda a, b: a >= b,
    "<=": lambda a, b: a <= b,
    "=": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
}
_MEASURES = {"COUNT": F.count, "SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}


def loose_text(text: SparkColumn) -> SparkColumn:
    """Lower case without commas, doubled spaces once made single."""
    return F.lower(F.replace(F.replace(text, F.lit(","), F.lit("")), F.lit("  "), F.lit(" ")))


class Lowering:
    """One plan over its relations: names to columns, and clauses in the order in which SQL applies them."""

    def __init__(self, catalog: Catalog, scope: Mapping[str, DataFrame] | None = None) -> None:
        self.catalog, self.frames, self.negated = catalog, dict(scope or {}), False

    def frame(self, name: str) -> DataFrame:
        return self.frames[name] if name in self.frames else self.catalog.frame(name)

    def infos(self, name: str) -> dict[str, ColumnInfo]:
        if name not in self.frames and name in self.catalog.tables:
            return dict(self.catalog.tables[name].columns)
        return {f.name: ColumnInfo(f.name, type_tag(f.name, f.dataType)) for f in self.frame(name).schema.fields}

    def run(self, plan: Plan) -> DataFrame:
        for cte in plan.ctes:
            made = Lowering(self.catalog, self.frames).run(cte.query)
            self.frames[cte.name] = made.toDF(*cte.columns) if cte.columns else made
        names = [plan.source, *(j.table for j in plan.joins)]
        self.scope = Scope({n: self.infos(n) for n in names})
        self.types = {n: {f.name: f.dataType for f in self.frame(n).schema.fields} for n in names}
        df = self.frame(plan.source).alias(plan.source)
        for join in plan.joins:
            left, right = join.left_table or plan.source, join.table
            on = self._of(left, join.left_column) == self._of(right, join.right_column)
            df = df.join(self.frame(right).alias(right), on, join.join_type.lower())
        tests = [self._tree(plan.where)] if plan.where else [self._leaf(x) for x in plan.filters]
        if tests:
            df = df.where(reduce(and_, tests))
        return self._grouped(df, plan) if plan.aggregations or plan.group_by else self._flat(df, plan)

    # names

    def _of(self, table: str, column: str) -> SparkColumn:
        return F.col(f"`{table}`.`{column.removeprefix(f'{table}.')}`")

    def _place(self, name: str) -> tuple[str, str]:
        found = self.scope.find(name)
        assert found is not None, name
        return found[0], found[1].name

    def _col(self, name: str) -> SparkColumn:
        return self._of(*self._place(name))

    # predicates

    def _literal(self, column: tuple[str, str], value: Any) -> SparkColumn:
        """A literal of the column's own type, so that no cast hides the column from the file reader."""
        kind = self.types[column[0]][column[1]]
        if isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType):
            if isinstance(value, str):
                value = datetime.fromisoformat(value)
            moment = value if isinstance(value, datetime) else datetime(value.year, value.month, value.day)
            if isinstance(kind, T.DateType) and moment.time() == datetime.min.time():
                return F.lit(moment.date())
            return F.lit(moment.isoformat(sep=" ")).cast(T.TimestampNTZType() if isinstance(kind, T.DateType) else kind)
        if isinstance(value, date | datetime):
            return F.lit(value.isoformat())
        if isinstance(value, bool) or not isinstance(value, int | float):
            return F.lit(value)
        if isinstance(kind, T.LongType | T.DoubleType) and isinstance(value, int):
            return F.lit(value).cast(kind)
        return F.lit(value)

    def _leaf(self, leaf: Compare | DateRange) -> SparkColumn:
        if isinstance(leaf, DateRange):
            place = self._place(leaf.column)
            column, ends = self._of(*place), []
            if leaf.start != date.min:
                ends.append(column >= self._literal(place, leaf.start))
            if leaf.end != date.max:
                ends.append(column < self._literal(place, leaf.end))
            return reduce(and_, ends) if ends else F.lit(True)
        operator, value = leaf.operator.upper(), leaf.value
        if isinstance(value, Subquery):
            inner = Lowering(self.catalog, self.frames).run(value.query)
            if operator == "EXISTS":
                return inner.exists()
            if operator == "NOT IN" and not self.negated:
                return self._not_in(self._col(leaf.column), inner)
            found = self._col(leaf.column).isin(inner)
            return ~found if operator == "NOT IN" else found
        place = self._place(leaf.column)
        column = self._of(*place)
        if operator == "IS NULL":
            return column.isNull()
        if operator == "IS NOT NULL":
            return column.isNotNull()
        if operator == "BETWEEN":
            return column.between(*(self._literal(place, x) for x in value))
        if operator in ("IN", "NOT IN"):
            found = column.isin(*(self._literal(place, x) for x in value))
            return ~found if operator == "NOT IN" else found
        if operator in ("LIKE", "NOT LIKE"):
            # the algebra has no escape character, and Spark's is the backslash
            found = F.lower(column.cast("string")).like(value.lower().replace("\\", "\\\\"))
            return ~found if operator == "NOT LIKE" else found
        text = isinstance(value, str) and isinstance(self.types[place[0]][place[1]], T.StringType)
        if text and operator in ("=", "!="):
            info = self.scope.relations[place[0]][place[1]]
            plain = loose_text if info.loose else F.lower
            return _COMPARE[operator](plain(column), plain(F.lit(value)))
        return _COMPARE[operator](column, self._literal(place, value))

    def _not_in(self, column: SparkColumn, inner: DataFrame) -> SparkColumn:
        """NOT IN where false and unknown are the same: an anti join on equality, which may be shuffled.

        Spark's own form must see nulls, and therefore broadcasts the subquery whatever its size. Here two subqueries of
        a single row tell whether it holds a null, and whether it is empty, in which case a null passes.
        """
        one = inner.toDF("__in")
        match = one.where(F.col("__in") == column.outer()).exists()
        return ~match & ~one.where(F.col("__in").isNull()).exists() & (column.isNotNull() | ~one.exists())

    def _tree(self, tree: Condition) -> SparkColumn:
        if tree.kind == "predicate":
            assert tree.predicate is not None
            return self._leaf(tree.predicate)
        before, self.negated = self.negated, self.negated or tree.kind == "not"
        parts = [self._tree(c) for c in tree.children]
        self.negated = before
        if tree.kind == "not":
            return ~parts[0]
        return reduce(and_ if tree.kind == "and" else or_, parts)

    # clauses

    def _flat(self, df: DataFrame, plan: Plan) -> DataFrame:
        windows = [w for w in plan.select if isinstance(w, WindowCall)]
        for w in windows:
            df = df.withColumn(w.output, self._window(w, self._col))
        made = {w.output for w in windows}
        shown: list[SparkColumn] = []
        for item in plan.select or ():
            if isinstance(item, WindowCall):
                shown.append(F.col(item.output))
            elif item.name == "*":
                shown += self._star(plan)
            else:
                shown.append(self._col(item.name).alias(self._place(item.name)[1]))
        if not plan.select:
            shown = self._star(plan)
        orders = [_directed(F.col(o.column) if o.column in made else self._col(o.column), o) for o in plan.order_by if o.column]
        if plan.distinct:
            df = df.select(*shown).distinct()
            orders = [_directed(F.col(o.column.rpartition(".")[2]), o) for o in plan.order_by if o.column]
            return self._cut(df.orderBy(*orders) if orders else df, plan)
        df = df.orderBy(*orders) if orders else df
        return self._cut(df, plan).select(*shown)

    def _star(self, plan: Plan) -> list[SparkColumn]:
        seen, out = set(), []
        for table, columns in self.scope.relations.items():
            for name in columns:
                out.append(self._of(table, name).alias(name if name not in seen else f"{table}__{name}"))
                seen.add(name)
        assert len(out) == len(star_columns(self.scope))
        return out

    def _grouped(self, df: DataFrame, plan: Plan) -> DataFrame:
        grains = dict(plan.time_grain)
        keys, by_place = [], {}
        for i, name in enumerate(plan.group_by):
            column = self._col(name)
            if name in grains:
                column = F.date_trunc(grains[name], column).cast("date")
            by_place[self._place(name)] = f"__key_{i}"
            keys.append(column.alias(f"__key_{i}"))
        hidden: dict[tuple[str, str, bool], str] = {}
        for of in [*plan.aggregations, *(h.left for h in plan.having), *(o.aggregation for o in plan.order_by if o.aggregation)]:
            hidden.setdefault(_same(of), f"__agg_{len(hidden)}")
        measures = []
        for (function, column, distinct), alias in hidden.items():
            of = Aggregate(function, column, None, distinct)
            measures.append(_measure(of, None if column == "*" else self._col(column)).alias(alias))
        df = df.groupBy(*keys).agg(*measures) if measures else df.select(*keys).distinct()
        for part in plan.having:
            df = df.where(_COMPARE[part.operator.upper()](F.col(hidden[_same(part.left)]), F.lit(part.value)))

        def named(name: str) -> SparkColumn:
            for of in plan.aggregations:
                if of.output == name:
                    return F.col(hidden[_same(of)])
            return F.col(by_place[self._place(name)])

        windows = {}
        for w in plan.select:
            if isinstance(w, WindowCall):
                windows[w.output] = f"__win_{len(windows)}"
                df = df.withColumn(windows[w.output], self._window(w, named))
        orders = []
        for o in plan.order_by:
            column = F.col(hidden[_same(o.aggregation)]) if o.aggregation else F.col(windows[o.column]) if o.column in windows else named(o.column or "")
            orders.append(_directed(column, o))
        shown = []
        for item in plan.select:
            if isinstance(item, WindowCall):
                shown.append(F.col(windows[item.output]).alias(item.output))
            else:
                shown.append(named(item.name).alias(self._place(item.name)[1]))
        shown += [F.col(hidden[_same(of)]).alias(of.output) for of in plan.aggregations]
        if plan.distinct:
            df = df.select(*shown, *[F.col(c) for c in df.columns]).dropDuplicates([x for x in _names(plan, self)])
        return self._cut(df.orderBy(*orders) if orders else df, plan).select(*(shown if not plan.distinct else [F.col(f"`{x}`") for x in _names(plan, self)]))

    def _window(self, call: WindowCall, named: Any) -> SparkColumn:
        over = Window.partitionBy(*(named(p) for p in call.partition_by))
        if call.order_by:
            over = over.orderBy(*(_directed(named(o.column), o) for o in call.order_by if o.column))
        name = call.function.upper()
        ranks = {"ROW_NUMBER": F.row_number, "RANK": F.rank, "DENSE_RANK": F.dense_rank}
        if name in ranks:
            return ranks[name]().over(over).cast("bigint")
        if name in ("LAG", "LEAD"):
            return (F.lag if name == "LAG" else F.lead)(named(call.column), 1).over(over)
        return _MEASURES[name](F.lit(1) if call.column == "*" else named(call.column)).over(over)

    def _cut(self, df: DataFrame, plan: Plan) -> DataFrame:
        return df.limit(plan.limit) if plan.limit is not None else df


def _measure(of: Aggregate, column: SparkColumn | None) -> SparkColumn:
    name = of.function.upper()
    if column is None:
        return F.count(F.lit(1))
    if of.distinct and name == "COUNT":
        return F.count_distinct(column)
    if of.distinct and name == "SUM":
        return F.sum_distinct(column)
    if of.distinct and name == "AVG":
        return F.sum_distinct(column.cast("double")) / F.count_distinct(column)
    return _MEASURES[name](column)


def _same(of: Aggregate) -> tuple[str, str, bool]:
    return of.function.upper(), of.column, of.distinct


def _names(plan: Plan, of: Lowering) -> list[str]:
    picked = [i.output if isinstance(i, WindowCall) else of._place(i.name)[1] for i in plan.select]
    return [*picked, *(a.output for a in plan.aggregations)]


def _directed(column: SparkColumn, order: Sort) -> SparkColumn:
    return column.desc() if order.direction.upper() == "DESC" else column.asc()


def lower(plan: Plan, catalog: Catalog, scope: Mapping[str, DataFrame] | None = None, check: bool = True) -> DataFrame:
    """The DataFrame of a plan, checked first; PlanError if it can't be run."""
    if check and not scope:
        Analyzer(catalog).check(plan)
    return Lowering(catalog, scope).run(plan)
