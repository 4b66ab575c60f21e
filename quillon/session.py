"""A session: the settings that the engine's semantics need, and tables by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.errors import SourceIOError
from quillon.operators.frame import Frame
from quillon.plans.binder import Binder
from quillon.plans.parser import parse
from quillon.sources.csv import CsvOptions, read_csv
from quillon.sources.parquet import read_parquet

#: Checked arithmetic and casts, exact column names, and no ordinals in ORDER BY.
SETTINGS = {"spark.sql.ansi.enabled": "true", "spark.sql.caseSensitive": "true", "spark.sql.orderByOrdinal": "false"}
_KEPT = ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone")


class Session:
    """Runs query texts over named tables, in a Spark session of its own settings."""

    def __init__(self, spark: SparkSession):
        self.spark = spark.newSession()
        for key in _KEPT:
            if (value := spark.conf.get(key, None)) is not None:
                self.spark.conf.set(key, value)
        for key, value in SETTINGS.items():
            self.spark.conf.set(key, value)
        self._tables: dict[str, Callable[[], Frame]] = {}

    def register(self, name: str, table: Frame | DataFrame | Callable[[], Frame]) -> None:
        """Name a table; a function is called when a query first needs it."""
        if isinstance(table, DataFrame):
            table = Frame.of(table)
        self._tables[name] = (lambda: table) if isinstance(table, Frame) else table

    def register_folder(self, folder: str, names: list[str], leave_out: bool = False) -> None:
        """Name the Parquet tables ``folder/<name>.parquet``; ``leave_out`` as for ``read_parquet``."""
        for name in names:
            self.register(name, lambda path=f"{folder}/{name}.parquet": read_parquet(self.spark, path, leave_out))

    def register_csv(self, name: str, path: str, options: CsvOptions = CsvOptions()) -> None:
        self.register(name, lambda: read_csv(self.spark, path, options))

    def table(self, name: str) -> Frame:
        if name not in self._tables:
            raise SourceIOError(f"no table named '{name}'")
        made = self._tables[name]()
        self._tables[name] = lambda: made
        return made

    def query(self, text: str) -> Frame:
        """A query text as a frame; its errors of syntax, names and types are raised here."""
        select = parse(text)
        table = self.table(select.table)
        return table.run(Binder(table.schema).bind(select))

    def sql(self, text: str) -> DataFrame:
        return self.query(text).df
