"""A Python data source over Parquet tables (`tablesmith`): the page scan as a plugged-in source, batch and stream.

Batch: a partition for each row group that can hold rows of the pushed filters, by the groups' least and greatest
values; filters on whole numbers and texts are evaluated in the tasks. Stream: an offset is a number of rows in the order
of files and row groups; each look at the source admits a bounded number of further rows, and they are read by tasks.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

NAME = "tablesmith"
#: Rows that a look at the stream admits, unless told by the option rowsPerBatch; rows a task of it reads at most, but
#: a row group is read by few tasks, as each decodes it from its beginning.
ADMITTED, TASK_ROWS, GROUP_TASKS = 100_000, 20_000, 4
_COMPARE = {EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal}


class Group(NamedTuple):
    """A row group: its file and number, its rows, and the least and greatest value of each column that has them."""

    file: str
    number: int
    rows: int
    bounds: dict[str, tuple]


class Rows(InputPartition):
    """Rows start to stop of a row group."""

    def __init__(self, file: str, number: int, start: int, stop: int):
        self.file, self.number, self.start, self.stop = file, number, start, stop


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")


def groups(path: str) -> list[Group]:
    """The row groups of a Parquet file, or of the files of a folder by name; only footers are read."""
    fs, at = _opened(path)
    told = fs.get_file_info(at)
    names = [at] if told.is_file else sorted(f.path for f in fs.get_file_info(pafs.FileSelector(at)) if f.is_file and f.base_name[0] not in "._")
    found = []
    for name in names:
        meta = pq.ParquetFile(fs.open_input_file(name)).metadata
        for k in range(meta.num_row_groups):
            g = meta.row_group(k)
            columns = [g.column(c) for c in range(g.num_columns)]
            found.append(Group(name, k, g.num_rows, {c.path_in_schema: (c.statistics.min, c.statistics.max) for c in columns if c.statistics is not None and c.statistics.has_min_max}))
    return found


def may_hold(group: Group, f: Filter) -> bool:
    """Whether a row group can have a row of which the filter is true."""
    low, high = group.bounds.get(f.attribute[0], (None, None))
    if low is None or isinstance(f, IsNotNull):
        return True
    values = f.value if isinstance(f, In) else (f.value,)
    inside = {EqualTo: lambda v: low <= v <= high, In: lambda v: low <= v <= high, GreaterThan: lambda v: high > v, GreaterThanOrEqual: lambda v: high >= v, LessThan: lambda v: low < v, LessThanOrEqual: lambda v: low <= v}[type(f)]
    return any(inside(v) for v in values)


class _Scan:
    """What batch and stream share: the columns asked for and reading a part of a row group."""

    def __init__(self, options: dict, schema: StructType):
        self.path, self.columns, self.filters = options["path"], schema.fieldNames(), []
        self.kinds = to_arrow_schema(schema)
        self.whole = {f.name: f.dataType.typeName() in ("long", "integer", "short", "byte", "string") for f in schema.fields}

    def read(self, part: Rows | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # Spark reads a source without partitions so
            return
        fs, _ = _opened(self.path)
        at = 0
        for batch in pq.ParquetFile(fs.open_input_file(part.file)).iter_batches(batch_size=2_000, row_groups=[part.number], columns=self.columns):
            if at >= part.stop:
                break
            low, high = max(part.start - at, 0), min(part.stop - at, batch.num_rows)
            at += batch.num_rows
            if low < high:
                rows = batch.slice(low, high - low).select(self.columns)
                for f in self.filters:
                    column = rows.column(f.attribute[0])
                    keep = column.is_valid() if isinstance(f, IsNotNull) else pc.is_in(column, pa.array(f.value, column.type)) if isinstance(f, In) else _COMPARE[type(f)](column, pa.scalar(f.value, column.type))
                    rows = rows.filter(keep)
                if rows.num_rows:
                    yield pa.RecordBatch.from_arrays([c.cast(f.type, safe=False) for c, f in zip(rows.columns, self.kinds, strict=True)], schema=self.kinds)


class TableReader(_Scan, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (*_COMPARE, In, IsNotNull)) and len(f.attribute) == 1 and self.whole.get(f.attribute[0]) and not (isinstance(f, In) and None in f.value):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Rows]:
        return [Rows(g.file, g.number, 0, g.rows) for g in groups(self.path) if all(may_hold(g, f) for f in self.filters)]


class TableStreamReader(_Scan, DataSourceStreamReader):
    """The end of the last planned batch is kept in the file of the option `progress`, so that after a restart the next
    look at the source goes on from there and admits no more rows than any other."""

    def __init__(self, options: dict, schema: StructType):
        super().__init__(options, schema)
        self.admitted, self.progress = int(options.get("rowsPerBatch", ADMITTED)), options["progress"]
        self.at, self.parts = None, None

    def _groups(self) -> list[Group]:
        self.parts = groups(self.path) if self.parts is None else self.parts
        return self.parts

    def _kept(self) -> int:
        fs, name = _opened(self.progress)
        if not fs.get_file_info(name).is_file:
            return 0
        with fs.open_input_file(name) as f:
            return json.loads(f.read())["rows"]

    def initialOffset(self) -> dict:
        return {"rows": 0}

    def latestOffset(self) -> dict:
        if self.at is None:
            self.at = self._kept()
        elif self.at == sum(g.rows for g in self._groups()):
            self.parts = None  # look for new files
        self.at = min(self.at + self.admitted, sum(g.rows for g in self._groups()))
        return {"rows": self.at}

    def partitions(self, start: dict, end: dict) -> list[Rows]:
        fs, name = _opened(self.progress)
        fs.create_dir(name.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(name) as f:
            f.write(json.dumps(end).encode())
        found, at = [], 0
        for g in self._groups():
            low, high = max(start["rows"] - at, 0), min(end["rows"] - at, g.rows)
            step = max(TASK_ROWS, -(-g.rows // GROUP_TASKS))
            found += [Rows(g.file, g.number, k, min(k + step, high)) for k in range(low, high, step)]
            at += g.rows
        return found

    def commit(self, end: dict) -> None:
        pass


class TableSource(DataSource):
    """Options: path; for streams rowsPerBatch and progress (a file of the query's own, beside its checkpoint)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        fs, _ = _opened(self.options["path"])
        return from_arrow_schema(pq.ParquetFile(fs.open_input_file(groups(self.options["path"])[0].file)).schema_arrow, prefer_timestamp_ntz=True)

    def reader(self, schema: StructType) -> TableReader:
        return TableReader(self.options, schema)

    def streamReader(self, schema: StructType) -> TableStreamReader:
        return TableStreamReader(self.options, schema)


def scan(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    """A table read by the source; a schema picks columns. Lets the session push filters to Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TableSource)
    reader = spark.read.format(NAME)
    return (reader.schema(schema) if schema else reader).option("path", path).load()


def follow(spark: SparkSession, path: str, progress: str, rows_per_batch: int = ADMITTED, schema: str | StructType | None = None) -> DataFrame:
    """A table as a stream, in the order of its files; see TableStreamReader."""
    spark.dataSource.register(TableSource)
    reader = spark.readStream.format(NAME)
    return (reader.schema(schema) if schema else reader).option("path", path).option("progress", progress).option("rowsPerBatch", rows_per_batch).load()
