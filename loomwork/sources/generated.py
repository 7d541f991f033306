"""A source that generates its rows: how tables that are computed, not stored, are read like any other."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Stretch(InputPartition):
    def __init__(self, begin: int, end: int) -> None:
        self.begin, self.end = begin, end


class _SquareReader(DataSourceReader):
    def __init__(self, n: int) -> None:
        self.n = n

    def partitions(self) -> list[InputPartition]:
        step = max(1, -(-self.n // 4))
        return [_Stretch(a, min(self.n, a + step)) for a in range(0, self.n, step)]

    def read(self, partition: _Stretch) -> Iterator[pa.RecordBatch]:
        n = list(range(partition.begin, partition.end))
        yield pa.record_batch([pa.array(n, pa.int64()), pa.array([x * x for x in n], pa.int64())], names=["n", "square"])


class Squares(DataSource):
    """Numbers below the option ``n`` with their squares, generated in four partitions."""

    @classmethod
    def name(cls) -> str:
        return "loomwork-squares"

    def schema(self) -> str:
        return "n long, square long"

    def reader(self, schema) -> DataSourceReader:
        return _SquareReader(int(self.options.get("n", "10")))


def squares(spark: SparkSession, n: int) -> DataFrame:
    spark.dataSource.register(Squares)
    return spark.read.format("loomwork-squares").option("n", str(n)).load()
