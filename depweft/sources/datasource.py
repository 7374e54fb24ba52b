"""A batch data source over recorded pages of a listing: one partition per page, read where it lies."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from depweft.runtime import ship


class PagesReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder, self.field = options["path"], options.get("field", "values")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(str(p)) for p in sorted(Path(self.folder).glob("*.json"))]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, int, str]]:
        body = json.loads(Path(partition.value).read_text(encoding="utf-8"))
        rows = body if isinstance(body, list) else body.get(self.field) or []
        for n, row in enumerate(rows):
            yield partition.value, n, json.dumps(row, ensure_ascii=False)


class PagesSource(DataSource):
    """``spark.read.format("pages").option("field", ...).load(folder)``: page, ord, body."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "page string, ord int, body string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return PagesReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and this package to its executors."""
    ship(spark)
    spark.dataSource.register(PagesSource)
