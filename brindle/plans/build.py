"""Bound queries to DataFrames. Lazy throughout, but for the row check of a scalar subquery."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.errors import IllegalSubquery, NoJoinStrategy
from brindle.plans import rewrite
from brindle.plans.binder import Aggregate, Attribute, Predicate, Query, kind_of
from brindle.sources.catalog import Catalog

_HINTS = {"enable_nestloop": "shuffle_replicate_nl", "enable_sortmerge": "merge", "enable_hashjoin": "shuffle_hash"}


@dataclass
class Knobs:
    """Join strategies are None until set: then Spark chooses."""

    enable_nestloop: bool | None = None
    enable_sortmerge: bool | None = None
    enable_hashjoin: bool | None = None
    enable_optimizer: bool = True
    output_file: bool = False

    def hint(self) -> str | None:
        """Of the strategies that are on, the first in the order above."""
        for knob, hint in _HINTS.items():
            if getattr(self, knob):
                return hint
        if all(getattr(self, k) is False for k in _HINTS):
            raise NoJoinStrategy()
        return None


class Builder:
    def __init__(self, catalog: Catalog, knobs: Knobs):
        self.catalog, self.knobs = catalog, knobs

    def scan(self, table: str) -> DataFrame:
        rows = self.catalog.read(table)
        return rows.select([F.col(f"`{c.name}`").alias(f"{table}__{c.name}") for c in self.catalog.table(table).columns])

    @staticmethod
    def column(x: Attribute | Aggregate) -> Column:
        return F.col(f"`{x.column}`")

    def value(self, left, v) -> Column:
        return F.lit(v).cast(left.type) if kind_of(left.type) == "time" and isinstance(v, str) else F.lit(v)

    def holds(self, p: Predicate) -> Column:
        """A predicate without subquery as a column."""
        left = self.column(p.left)
        if isinstance(p.right, tuple):
            return left.isin([self.value(p.left, v) for v in p.right])
        right = self.column(p.right) if isinstance(p.right, (Attribute, Aggregate)) else self.value(p.left, p.right)
        return {"=": left == right, "<>": left != right, "<": left < right, ">": left > right, "<=": left <= right, ">=": left >= right}[p.op]

    def filtered(self, rows: DataFrame, predicates) -> DataFrame:
        for p in predicates:
            if not isinstance(p.right, Query):
                rows = rows.where(self.holds(p))
            elif p.op == "IN":
                inner = self.select(p.right).toDF("_in")
                rows = rows.join(inner, self.column(p.left) == F.col("_in"), "left_semi")
            else:
                value = self.scalar(p.right)
                rows = rows.where(F.lit(False) if value is None else self.holds(Predicate(p.left, p.op, value)))
        return rows

    def scalar(self, q: Query):
        """The value of a subquery that must have one row."""
        found = self.select(q).limit(2).collect()
        if len(found) != 1:
            raise IllegalSubquery("it has more rows than one" if found else "it has no row")
        return found[0][0]

    def source(self, q: Query) -> DataFrame:
        """FROM and WHERE: filters on the tables, then a fold of joins."""
        predicates, order, nothing = list(q.where), list(q.tables), False
        if self.knobs.enable_optimizer:
            predicates, nothing = rewrite.simplify(predicates)
            nothing = nothing or rewrite.contradictory(predicates)
            known = {t: s for t in q.tables if (s := self.catalog.table(t).statistics)}
            order = rewrite.join_order(q.tables, predicates, known)
        single = [p for p in predicates if len(p.tables) == 1]
        across = [p for p in predicates if len(p.tables) > 1]
        hint = self.knobs.hint() if len(order) > 1 else None
        joined: DataFrame | None = None
        have: set[str] = set()
        for table in order:
            rows = self.filtered(self.scan(table), [p for p in single if p.tables == {table}])
            if nothing:
                rows = rows.where(F.lit(False))
            have.add(table)
            if joined is None:
                joined = rows
                continue
            on = [p for p in across if table in p.tables and p.tables <= have]
            rows = rows.hint(hint) if hint else rows
            joined = joined.join(rows, reduce(Column.__and__, map(self.holds, on)), "inner") if on else joined.crossJoin(rows)
        return joined

    def aggregate(self, rows: DataFrame, q: Query) -> DataFrame:
        wanted = [*q.output, *(x for p in q.having for x in (p.left, p.right)), *([q.order[0]] if q.order else [])]
        functions = {"COUNT": F.count, "SUM": F.sum, "MIN": F.min, "MAX": F.max}
        made = {x.column: functions[x.function](self.column(x.of) if x.of else F.lit(1)).alias(x.column) for x in wanted if isinstance(x, Aggregate)}
        keys = [self.column(x) for x in q.group]
        if not made:
            return rows.select(keys).distinct()
        return rows.groupBy(*keys).agg(*made.values())

    def from_statistics(self, q: Query) -> DataFrame | None:
        """The row of an aggregate that the table's statistics know, without a scan."""
        if len(q.tables) != 1 or q.where or q.group or q.having or q.order or not self.knobs.enable_optimizer:
            return None
        known = self.catalog.table(q.tables[0]).statistics
        if known is None or not all(isinstance(x, Aggregate) for x in q.output):
            return None
        values = []
        for x in q.output:
            if x.of is None and x.function == "COUNT":
                values.append(known.rows)
                continue
            measure = {"MIN": known.least, "MAX": known.most, "SUM": known.total}.get(x.function, {})
            if not known.whole or x.of.name not in measure or x.function == "SUM" and x.type == "double":  # a sum of floats depends on its order
                return None
            values.append(measure[x.of.name])
        return self.catalog.spark.range(1).select([F.lit(v).cast(x.type).alias(n) for v, x, n in zip(values, q.output, q.names, strict=True)])

    def select(self, q: Query) -> DataFrame:
        if q.aggregated and (found := self.from_statistics(q)) is not None:
            return found
        rows = self.source(q)
        if q.aggregated:
            rows = self.filtered(self.aggregate(rows, q), q.having)
        output = [self.column(x).alias(n) for x, n in zip(q.output, q.names, strict=True)]
        if not q.order:
            rows = rows.select(output)
            return rows.distinct() if q.unique else rows
        key, descending = q.order
        by = F.col("`_key`").desc_nulls_last() if descending else F.col("`_key`").asc_nulls_first()
        rows = rows.select(*output, self.column(key).alias("_key"))
        if q.unique:
            # a key that isn't selected orders equal rows by its first value
            if key in q.output:
                rows = rows.distinct()
            else:
                rows = rows.groupBy(*(F.col(f"`{n}`") for n in q.names)).agg((F.max if descending else F.min)("_key").alias("_key"))
        return rows.orderBy(by).select([F.col(f"`{n}`") for n in q.names])
