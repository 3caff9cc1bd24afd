"""Live views of a database as a partitioned source, over any DB-API driver.

    spark.read.format("liveview").schema(ddl).options(connect="psycopg:connect", target=dsn, query="SELECT ...", key="relid", parts=16).load()

Every task opens a connection of its own and reads one range of the key, or the null keys, in batches. Filters that the database
answers as Spark would go into its WHERE clause, as parameters; Spark checks all others.
"""

from __future__ import annotations

import importlib
import math
from collections.abc import Iterable, Iterator, Mapping
from datetime import date, datetime
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

NAME = "liveview"
COMPARED = {EqualTo: "=", EqualNullSafe: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
#: How a driver marks parameters in a statement.
MARKS = {"qmark": "?", "format": "%s", "pyformat": "%s"}


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class KeyRange(InputPartition):
    """Keys from `low` on and below `high`, each open if None; or the null keys; or, without a key, all rows."""

    def __init__(self, low: int | None, high: int | None, nulls: bool = False):
        super().__init__((low, high, nulls))
        self.low, self.high, self.nulls = low, high, nulls


def key_ranges(low: int | None, high: int | None, parts: int) -> list[tuple[int | None, int | None]]:
    """At most `parts` ranges of equal width that cover every whole number, also those outside low..high, which a live view may get
    while it is read."""
    if low is None or high is None:
        return [(None, None)]
    n = max(1, min(parts, high - low + 1))
    cuts = [low + (high - low + 1) * i // n for i in range(1, n)]
    return list(zip([None, *cuts], [*cuts, None], strict=True))


class LiveViewReader(DataSourceReader):
    def __init__(self, schema: StructType, options: Mapping[str, str]):
        self.schema_, self.options = schema, dict(options)
        missing = [o for o in ("connect", "target", "query") if o not in self.options]
        if missing:
            raise ValueError(f"a live view needs {missing}")
        self.key, self.parts = self.options.get("key"), int(self.options.get("parts", "1"))
        self.fetch = int(self.options.get("fetchsize", "10000"))
        if self.parts < 1 or self.fetch < 1 or (self.parts > 1 and not self.key):
            raise ValueError("parts and fetchsize are at least 1, and parts need a key")
        self.times = self.options.get("times", "false").lower() == "true"
        self.where: list[str] = []
        self.args: list[object] = []

    def _driver(self):
        module, _, function = self.options["connect"].partition(":")
        found = importlib.import_module(module)
        return getattr(found, function or "connect"), MARKS[found.paramstyle]

    def _rows(self, columns: str, where: list[str], args: list[object]) -> Iterator[list[tuple]]:
        connect, mark = self._driver()
        condition = " AND ".join(where).replace("?", mark)
        names = condition and f" WHERE {condition}"
        connection = connect(self.options["target"])
        try:
            cursor = connection.cursor()
            # a query without parameters is sent as it stands, as some drivers read % in it otherwise
            text = f"SELECT {columns} FROM ({self.options['query']}) AS v{names}"
            cursor.execute(text, args) if args else cursor.execute(text)
            while rows := cursor.fetchmany(self.fetch):
                yield rows
        finally:
            connection.close()

    def _as_spark_does(self, op: str, value: object) -> bool:
        """Whether the database compares such a value as Spark does: numbers, texts for equality only (collations differ), and times if the
        option `times` says so. Booleans and NaN are left to Spark."""
        if isinstance(value, bool) or value is None:
            return False
        if isinstance(value, float):
            return math.isfinite(value)
        if isinstance(value, (date, datetime)):
            return self.times
        return isinstance(value, (int, Decimal)) or (isinstance(value, str) and op == "=")

    def _pushed(self, f: Filter) -> tuple[str, list[object]] | None:
        if len(getattr(f, "attribute", ())) != 1 or "?" in f.attribute[0] or "%" in f.attribute[0]:
            return None
        name = quoted(f.attribute[0])
        if isinstance(f, (IsNull, IsNotNull)):
            return f"{name} IS {'NOT ' if isinstance(f, IsNotNull) else ''}NULL", []
        if isinstance(f, In):
            values = list(f.value)
            return (f"{name} IN ({', '.join('?' * len(values))})", values) if values and all(self._as_spark_does("=", v) for v in values) else None
        op = COMPARED.get(type(f))
        if op is None or not self._as_spark_does(op, f.value):
            return None
        return f"{name} {op} ?", [f.value]

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            pushed = self._pushed(f)
            if pushed is None:
                yield f
            else:
                self.where.append(pushed[0])
                self.args.extend(pushed[1])

    def partitions(self) -> list[KeyRange]:
        if not self.key or self.parts == 1:
            return [KeyRange(None, None)]
        name = quoted(self.key)
        ((low, high),) = next(self._rows(f"min({name}), max({name})", self.where, self.args))
        return [*(KeyRange(a, b) for a, b in key_ranges(low, high, self.parts)), KeyRange(None, None, nulls=True)]

    def read(self, partition: KeyRange) -> Iterator[pa.RecordBatch]:
        where, args = list(self.where), list(self.args)
        if self.key and self.parts > 1:
            name = quoted(self.key)
            if partition.nulls:
                where.append(f"{name} IS NULL")
            else:
                where.append(f"{name} IS NOT NULL")
            for op, bound in ((">=", partition.low), ("<", partition.high)):
                if bound is not None:
                    where.append(f"{name} {op} ?")
                    args.append(bound)
        shape = to_arrow_schema(self.schema_)
        for rows in self._rows(", ".join(quoted(f.name) for f in self.schema_), where, args):
            columns = [pa.array(column, type=field.type) for column, field in zip(zip(*rows, strict=True), shape, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, schema=shape)


class LiveView(DataSource):
    """Options: connect (module:function of a DB-API driver), target (what the function is called with), query; key and parts (a whole-number
    column, and the number of its ranges), fetchsize, times (whether comparisons of times may be sent to the database)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        raise ValueError("give the columns by .schema(); a live view is not read to guess them")

    def reader(self, schema: StructType) -> LiveViewReader:
        return LiveViewReader(schema, self.options)


def read_live_view(spark: SparkSession, ddl: str, connect: str, target: str, query: str, **options: object) -> DataFrame:
    """A view's columns `ddl`, read in parts if `key` and `parts` are given, with filters sent to the database.

    Only the columns of `ddl` are asked for. Rows with a null key are a part of their own, and the first and last part are open, so no row is left out, whatever
    the view does between finding its key range and being read; parts are not one snapshot. An empty view gives no rows.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LiveView)
    return spark.read.format(NAME).schema(ddl).options(connect=connect, target=target, query=query, **{k: str(v) for k, v in options.items()}).load()
