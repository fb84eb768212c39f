"""A keyed table over Parquet generations: create, upsert, delete, snapshot. Each write is a new generation, read by its number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException

from millrace.operators import state


class KeyedTable:
    """schema needs the key and an order column; of rows with one key the last by order holds."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, order: str) -> None:
        self.spark, self.path, self.schema, self.key, self.order, self.generation = spark, path.rstrip("/"), schema, key, order, 0

    def create(self) -> "KeyedTable":
        """Create the table if it doesn't exist, or open its last generation."""
        n = 0
        while True:
            try:
                self.spark.read.schema(self.schema).parquet(f"{self.path}/{n + 1}")
            except AnalysisException:
                break
            n += 1
        self.generation = n
        return self

    def snapshot(self) -> DataFrame:
        """All rows, stale ones too."""
        if not self.generation:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{self.generation}")

    def _next(self, df: DataFrame) -> None:
        df.write.parquet(f"{self.path}/{self.generation + 1}")
        self.generation += 1

    def put(self, rows: DataFrame) -> None:
        self._next(state.put(self.snapshot(), rows, self.key, self.order))

    def delete(self, keys: DataFrame) -> None:
        self._next(state.deleted(self.snapshot(), keys, self.key))

    def clear(self) -> None:
        self._next(state.cleared(self.snapshot()))

    def get(self, value) -> DataFrame:
        return state.get(self.snapshot(), self.key, value)
