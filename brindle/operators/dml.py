"""INSERT, DELETE, UPDATE, LOAD and unique indexes, as set operations that write new snapshots."""

from __future__ import annotations

from dataclasses import replace

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.errors import DuplicateKey, IncompatibleTypes, LoadFault, NullViolation, StringTooLong, ValueCountMismatch
from brindle.functions.scalar import arithmetic
from brindle.plans.binder import Binder, Predicate, Query, kind_of, kind_of_value
from brindle.plans.build import Builder
from brindle.sources import delimited
from brindle.sources.catalog import NUMERIC, Catalog, ColumnMeta, Statistics, TableMeta, add_index, collect_statistics, merged_statistics
from brindle.sql import ast


class Writer:
    def __init__(self, catalog: Catalog, binder: Binder, builder: Builder):
        self.catalog, self.binder, self.builder = catalog, binder, builder

    # --- checks

    @staticmethod
    def check_value(column: ColumnMeta, value: object) -> None:
        if value is None:
            if column.not_null:
                raise NullViolation(column.name)
            return
        if kind_of_value(value) != kind_of(column.type) and not (kind_of(column.type) == "time" and isinstance(value, str)):
            raise IncompatibleTypes(f"{kind_of(column.type)} and {kind_of_value(value)}")
        if column.length and isinstance(value, str) and len(value) > column.length:
            raise StringTooLong(column.name)

    @staticmethod
    def check_rows(table: TableMeta, rows: DataFrame) -> None:
        """Lengths and NULLs of whole rows, in one pass."""
        tests: dict[str, tuple[type, str, Column]] = {}
        for c in table.columns:
            if c.length:
                tests[f"long:{c.name}"] = (StringTooLong, c.name, F.length(f"`{c.name}`") > c.length)
            if c.not_null:
                tests[f"null:{c.name}"] = (NullViolation, c.name, F.col(f"`{c.name}`").isNull())
        if tests:
            found = rows.agg(*(F.bool_or(t).alias(k) for k, (_, _, t) in tests.items())).first()
            for k, (error, name, _) in tests.items():
                if found[k]:
                    raise error(name)

    @staticmethod
    def check_unique(table: TableMeta, rows: DataFrame, indexes=None) -> None:
        for index in table.indexes if indexes is None else indexes:
            if rows.groupBy(*(F.col(f"`{c}`") for c in index)).count().where("count > 1").limit(1).count():
                raise DuplicateKey(f"{table.name}.({','.join(index)})")

    def check_new(self, table: TableMeta, rows: DataFrame) -> None:
        """New rows against one another and, by a semi join on the key, against those of the table."""
        self.check_unique(table, rows)
        for index in table.indexes if table.paths else ():
            keys = rows.select([F.col(f"`{c}`") for c in index])
            old = self.catalog.read(table.name).select([F.col(f"`{c}`").alias(f"_old{k}") for k, c in enumerate(index)])
            same = [F.col(f"`{c}`") == F.col(f"_old{k}") if table.column(c).not_null else F.col(f"`{c}`").eqNullSafe(F.col(f"_old{k}")) for k, c in enumerate(index)]
            if keys.join(old, same, "left_semi").limit(1).count():
                raise DuplicateKey(f"{table.name}.({','.join(index)})")

    # --- statements

    def insert(self, s: ast.Insert) -> int:
        table = self.catalog.table(self.binder.table_name(s.table))
        if len(s.values) != len(table.columns):
            raise ValueCountMismatch()
        values = [v.value for v in s.values]
        for c, v in zip(table.columns, values, strict=True):
            self.check_value(c, v)
        row = self.catalog.spark.range(1).select([F.lit(v).cast(c.type).alias(c.name) for c, v in zip(table.columns, values, strict=True)])
        own = dict(zip([c.name for c in table.columns], values, strict=True))
        for index in table.indexes:  # a filter by the key reaches the scan
            rows = self.catalog.read(table.name)
            for c in index:
                rows = rows.where(F.col(f"`{c}`") == F.lit(own[c]).cast(table.column(c).type))
            if rows.limit(1).count():
                raise DuplicateKey(f"{table.name}.({','.join(index)})")
        made = replace(table, paths=(*table.paths, self.catalog.write(table, row, level="level0-")), statistics=_with_row(table, own))
        self.catalog.put(self.catalog.merged(made))
        return 1

    def _matching(self, table: TableMeta, where, files: list[str] | None = None) -> tuple[DataFrame, Column]:
        """Rows under their own names, with _file and _hit: whether the conditions hold. Subqueries in IN are joined for a mark."""
        predicates = self.binder.where(where, (table.name,))
        rows = self.catalog.read(table.name)
        source = F.col("_metadata.file_name") if table.paths else F.lit("")
        if files is not None:  # the others aren't even listed
            rows = rows.where(source.isin(*files))
        rows = rows.select(source.alias("_file"), *(F.col(f"`{c.name}`").alias(f"{table.name}__{c.name}") for c in table.columns))
        hit: Column = F.lit(True)
        for k, p in enumerate(predicates):
            if p.op == "IN" and not isinstance(p.right, tuple):
                inner = self.builder.select(p.right).toDF(f"_in{k}").distinct().withColumn(f"_is{k}", F.lit(True))
                rows = rows.join(inner, self.builder.column(p.left) == F.col(f"_in{k}"), "left")
                hit = hit & F.coalesce(F.col(f"_is{k}"), F.lit(False))
            elif isinstance(p.right, Query):
                value = self.builder.scalar(p.right)
                hit = hit & (F.lit(False) if value is None else self.builder.holds(Predicate(p.left, p.op, value)))
            else:
                hit = hit & self.builder.holds(p)
        names = [F.col(f"`{table.name}__{c.name}`").alias(c.name) for c in table.columns]
        return rows.select("_file", *names, F.coalesce(hit, F.lit(False)).alias("_hit")), F.col("_hit")

    def _hits(self, table: TableMeta, where) -> tuple[int, list[str]]:
        """How many rows a change takes, and the names of the files that hold them."""
        rows, hit = self._matching(table, where)
        found = rows.where(hit).groupBy("_file").count().collect()  # at most a row for each file
        return sum(r["count"] for r in found), sorted(r["_file"] for r in found)

    def delete(self, s: ast.Delete) -> int:
        """Writes anew the files that lose some of their rows; all others stay."""
        table = self.catalog.table(self.binder.table_name(s.table))
        n, files = self._hits(table, s.where)
        if n:
            statistics = table.statistics and Statistics(table.statistics.rows - n, whole=False)
            rest = None
            if s.where:
                rows, hit = self._matching(table, s.where, files)
                rest = self.catalog.write(table, rows.where(~hit))
            self.catalog.put(replace(self.catalog.replaced(table, files, rest), statistics=statistics))
        return n

    def update(self, s: ast.Update) -> int:
        table = self.catalog.table(self.binder.table_name(s.table))
        changes: dict[str, Column] = {}
        for a in s.assignments:
            column = table.column(a.column, self.binder.any_case)
            if isinstance(a.value, ast.Arithmetic):
                old = table.column(a.value.column, self.binder.any_case)
                value = a.value.value.value
                if kind_of(old.type) != "number" or kind_of_value(value) != "number" or kind_of(column.type) != "number":
                    raise IncompatibleTypes(f"{old.type} {a.value.op} {kind_of_value(value)}")
                whole = isinstance(value, int) and old.type in ("int", "bigint", "smallint", "tinyint")
                changes[column.name] = arithmetic(a.value.op, F.col(f"`{old.name}`"), F.lit(value), whole).cast(column.type)
            else:
                self.check_value(column, a.value.value)
                changes[column.name] = F.lit(a.value.value).cast(column.type)
        n, files = self._hits(table, s.where)
        if n:
            rows, hit = self._matching(table, s.where, files)
            # every right side reads the old values
            new = rows.select([(F.when(hit, changes[c.name]).otherwise(F.col(f"`{c.name}`")) if c.name in changes else F.col(f"`{c.name}`")).alias(c.name) for c in table.columns])
            keyed = [i for i in table.indexes if set(i) & changes.keys()]
            if keyed:  # new keys may meet those of files that stay
                every, _ = self._matching(table, s.where)
                stays = every.where(~F.col("_file").isin(*files)).select(new.columns)
                self.check_unique(table, new.unionByName(stays), keyed)
            statistics = table.statistics and Statistics(table.statistics.rows, whole=False)
            self.catalog.put(replace(self.catalog.replaced(table, files, self.catalog.write(table, new)), statistics=statistics))
        return n

    def load(self, s: ast.Load) -> int:
        table = self.catalog.table(self.binder.table_name(s.table))
        try:
            path = self.catalog.write(table, delimited.read(self.catalog.spark, s.path, table))
        except PySparkException as fault:
            raise LoadFault(f"{s.path}: {str(fault).splitlines()[0]}") from fault
        rows = self.catalog.plain(table, self.catalog.spark.read.schema(table.schema).parquet(path))
        self.check_rows(table, rows)
        self.check_new(table, rows)
        own = collect_statistics(rows, table)
        known = table.statistics if table.paths else Statistics(0)
        self.catalog.put(replace(table, paths=(*table.paths, path), statistics=merged_statistics(self.catalog.spark, known, own)))
        return own.rows

    def create_index(self, s: ast.CreateIndex) -> None:
        """Checks uniqueness and deals the table out by the key, sorted: the layout of an index-merge join."""
        table = self.catalog.table(self.binder.table_name(s.table))
        columns = tuple(table.column(c, self.binder.any_case).name for c in s.columns)
        made = add_index(table, columns)
        rows = self.catalog.read(table.name)
        self.check_unique(table, rows, [columns])
        laid_out = table.buckets and table.buckets[1] in table.indexes
        self.catalog.put(made if laid_out else self._dealt(made, rows, columns))

    def _dealt(self, table: TableMeta, rows: DataFrame, columns: tuple[str, ...]) -> TableMeta:
        """The table laid out by a key: one snapshot, to which later ones of the same buckets are added."""
        n = int(self.catalog.spark.conf.get("spark.sql.shuffle.partitions"))
        paths = (self.catalog.write_buckets(table, rows, n, columns),) if table.paths else ()
        return replace(table, paths=paths, buckets=(n, columns), dead=())

    def compact(self) -> None:
        """Tables of several snapshots become one, laid out by their first index if they have one."""
        for table in list(self.catalog.tables.values()):
            if len(table.paths) > 1 or table.dead:
                rows = self.catalog.read(table.name)
                if table.indexes:
                    self.catalog.put(self._dealt(table, rows, table.indexes[0]))
                else:
                    flat = replace(table, buckets=None)
                    self.catalog.put(replace(flat, paths=(self.catalog.write(flat, rows),), dead=()))


def _with_row(table: TableMeta, values: dict[str, object]) -> Statistics | None:
    """The table's statistics with one row more; its distinct counts stay as they are, an estimate."""
    old = table.statistics if table.paths else Statistics(0)
    if old is None or not old.whole:
        return old and replace(old, rows=old.rows + 1)
    own = {c.name: values[c.name] for c in table.columns if c.type in NUMERIC and values[c.name] is not None}
    fold = {"least": min, "most": max, "total": lambda x, y: x + y}
    return replace(old, rows=old.rows + 1, **{m: getattr(old, m) | {n: f(getattr(old, m)[n], v) if n in getattr(old, m) else v for n, v in own.items()} for m, f in fold.items()})
