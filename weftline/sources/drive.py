"""A drive of documents as a Spark data source: the driver sees page tokens only, executors read the pages."""

from __future__ import annotations

import datetime as dt
import importlib
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition

SCHEMA = "name string, source string, modified timestamp, text string"


class Provider:
    """What a drive must offer; made anew on the driver and in every task from the options of the read, which are strings."""

    def __init__(self, options: dict[str, str]):
        self.options = options

    def pages(self, since: dt.datetime | None) -> Iterable[str]:
        """Tokens of the pages that may have documents changed at ``since`` or later; called on the driver."""
        raise NotImplementedError

    def read(self, page: str, since: dt.datetime | None) -> Iterator[tuple[str, dt.datetime, str]]:
        """(name, modified, text) of the documents of a page; called in a task."""
        raise NotImplementedError


class Page(InputPartition):
    def __init__(self, token: str):
        super().__init__(token)
        self.token = token


class DriveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = dict(options)
        self.since: dt.datetime | None = None
        self.named: str | None = None

    def _provider(self) -> Provider:
        module, _, name = self.options["provider"].partition(":")
        return getattr(importlib.import_module(module), name)(self.options)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("modified",):
                value = f.value.replace(tzinfo=None) if f.value.tzinfo is None else f.value.astimezone(dt.timezone.utc).replace(tzinfo=None)
                self.since = max(filter(None, (self.since, value)))
            elif isinstance(f, EqualTo) and f.attribute == ("name",):
                self.named = f.value
            yield f  # Spark compares again

    def partitions(self) -> list[InputPartition]:
        return [Page(t) for t in self._provider().pages(self.since)] or [Page("")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not partition.token:
            return
        for name, modified, text in self._provider().read(partition.token, self.since):
            if (self.since is None or modified >= self.since) and (self.named is None or name == self.named):
                yield name, "cloud", modified, text


class DriveSource(DataSource):
    """``spark.read.format("weftline_drive").option("provider", "module:Class")``; all options go to the provider."""

    @classmethod
    def name(cls) -> str:
        return "weftline_drive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DriveReader:
        return DriveReader(self.options)


def read_drive(spark: SparkSession, provider: str, since: str | None = None, **options: str) -> DataFrame:
    """Documents (name, source, modified, text) of a drive, changed at ``since`` or later; ``provider`` is ``module:Class``.

    A comparison of ``modified`` with a time and of ``name`` with a name reaches the provider.
    """
    spark.dataSource.register(DriveSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    out = spark.read.format("weftline_drive").option("provider", provider).options(**options).load()
    return out if since is None else out.where(f"modified >= timestamp'{since}'")
