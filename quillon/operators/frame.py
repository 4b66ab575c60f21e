"""Filter, sort, limit and project, lazily, over a DataFrame with a logical schema."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from quillon.errors import SqlTypeError, translating
from quillon.functions import lowering
from quillon.plans.binder import Binder, Bound, BoundQuery, Projection, SortKey
from quillon.plans.parser import parse
from quillon.plans.types import LField, LSchema, LType

_MOST_ROWS = (1 << 31) - 1


@dataclass(frozen=True)
class Frame:
    """A DataFrame and its logical schema; operators return new frames and run nothing.

    ``stored_order`` says that rows have a place in Parquet files, which breaks ties and
    decides what comes first; otherwise the place is that in the input's partitions.
    """

    df: DataFrame
    schema: LSchema
    stored_order: bool = False
    sorted: bool = False

    @classmethod
    def of(cls, df: DataFrame, known: LSchema | None = None) -> Frame:
        """A frame over any DataFrame whose columns have types of the engine, or widen to them."""
        schema = LSchema.of_spark(df.schema, known)
        return cls(df.select(*[widened(f) if type(old.dataType) is not type(f.type.spark) else lowering.name(f.name) for f, old in zip(schema, df.schema.fields, strict=True)]), schema)

    def filter(self, condition: Bound) -> Frame:
        """Rows for which the condition is TRUE; FALSE and NULL drop a row."""
        if condition.typed() is not LType.BOOLEAN:
            raise SqlTypeError(f"a filter must be Boolean, not {condition.type}")
        return replace(self, df=self.df.filter(lowering.condition(condition)))

    def sort(self, keys: Sequence[SortKey]) -> Frame:
        """Rows by the keys, equal ones as they came; NULL is least and NaN greatest."""
        orders = [_order(k) for k in keys if k.expr.op != "literal"]
        return replace(self._in_order(orders), sorted=True)

    def limit(self, n: int) -> Frame:
        """The first n rows: of the order if sorted, else of the input.

        Of many files only as many are read, in the order of their paths, as hold n rows;
        the first few are counted for that.
        """
        if n > _MOST_ROWS:
            return self
        first = self if self.sorted or n == 0 else replace(self, df=self._first_files(n))._in_order([])
        return replace(first, df=first.df.limit(n))

    def _first_files(self, n: int) -> DataFrame:
        files = sorted(self.df.inputFiles()) if self.stored_order else []
        some = 1
        while some < len(files):
            part = self.df.where(F.col("_metadata.file_path") <= files[some - 1])
            if part.limit(n).count() >= n:
                return part
            some *= 8
        return self.df

    def project(self, projections: Sequence[Projection]) -> Frame:
        """The named expressions; names must differ."""
        schema = LSchema([LField(p.name, p.expr.typed(), p.expr.nullable) for p in projections])
        return replace(self, df=self.df.select(*[lowering.value(p.expr).alias(p.name) for p in projections]), schema=schema)

    def run(self, query: BoundQuery) -> Frame:
        """A bound query: filter, sort, limit, and only then project."""
        out = self if query.filter is None else self.filter(query.filter)
        out = out.sort(query.order_by) if query.order_by else out
        out = out if query.limit is None else out.limit(query.limit)
        return out.project(query.projections)

    def sql(self, text: str) -> Frame:
        """A query text over this frame, whatever table it names."""
        return self.run(Binder(self.schema).bind(parse(text)))

    def collect(self) -> list[Row]:
        """All rows at the driver, Spark's errors translated. For results, not for tables."""
        with translating():
            return self.df.collect()

    def _in_order(self, orders: list[Column]) -> Frame:
        if self.stored_order:
            return replace(self, df=self.df.orderBy(*orders, F.col("_metadata.file_path"), F.col("_metadata.row_index")))
        place = "place"
        while place in self.df.columns:
            place += "_"
        # After the filter, where it does not keep predicates from the scan.
        placed = self.df.withColumn(place, F.monotonically_increasing_id())
        return replace(self, df=placed.orderBy(*orders, place).drop(place))


def widened(field: LField) -> Column:
    return lowering.name(field.name).cast(field.type.spark).alias(field.name)


def _order(key: SortKey) -> Column:
    c = lowering.value(key.expr)
    return c.asc_nulls_first() if key.ascending else c.desc_nulls_last()


def execute(sql: str, df: DataFrame) -> DataFrame:
    """A query text over a DataFrame; the table name in the text is not looked at."""
    return Frame.of(df).sql(sql).df
