"""Tables whose columns can be added and renamed: a column has an id for good, which is its name in the Parquet files.

(Spark's own field ids in Parquet files don't allow a new column under the old name of a renamed one.)
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DataType, StructField, StructType

from tablesmith.plans.manifest import Change, Manifest

ID = "id"


def _stored(field: StructField) -> str:
    """A column's name in files."""
    return f"c{field.metadata[ID]}"


class EvolvingTable:
    """A table under a manifest. A version's columns are its schema's; old files are read by the ids of the columns, so
    a renamed column keeps its values and an added one is null where files don't have it."""

    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark, self.name, self.manifest = spark, name, Manifest(spark, root)

    def schema(self) -> StructType:
        self.manifest.refresh()
        told = self.manifest.values.get(self.name)
        return StructType.fromJson(json.loads(told)) if told else StructType([])

    def _change(self) -> Change:
        return Change(self.manifest, self.name, [f"={self.name}/"])

    def _set(self, change: Change, fields: list[StructField]) -> None:
        if len({f.name.lower() for f in fields}) < len(fields):
            raise ValueError("two columns would have one name")
        change.set(self.name, json.dumps(StructType(fields).jsonValue()))
        change.finish()

    def add_column(self, name: str, kind: DataType) -> None:
        """A new column, null in the rows that are there; its id is beyond all that the table ever had."""
        change, fields = self._change(), self.schema().fields
        self._set(change, [*fields, StructField(name, kind, True, {ID: 1 + max((f.metadata[ID] for f in fields), default=0)})])

    def rename_column(self, old: str, new: str) -> None:
        change, fields = self._change(), self.schema().fields
        if old not in [f.name for f in fields]:
            raise ValueError(f"no column {old}")
        self._set(change, [StructField(new, f.dataType, True, f.metadata) if f.name == old else f for f in fields])

    def append(self, rows: DataFrame) -> None:
        """Rows of the present columns, by name; refused if the columns are changed meanwhile."""
        change, schema = self._change(), self.schema()
        change.put(self.name, rows.select(*[rows[f.name].cast(f.dataType).alias(_stored(f)) for f in schema.fields]))
        change.finish()

    def read(self) -> DataFrame:
        schema = self.schema()
        folders = self.manifest.folders(self.name, self.name)
        if not folders:
            return self.spark.createDataFrame([], schema)
        stored = StructType([StructField(_stored(f), f.dataType, True) for f in schema.fields])
        return self.spark.read.schema(stored).parquet(*folders).toDF(*schema.fieldNames())
