"""A drive for the queries: a table of the driver, whose row groups are the pages."""

from __future__ import annotations

import datetime as dt
import os
from collections.abc import Iterable, Iterator

import pyarrow.parquet as pq

from ..sources.drive import Provider


class TableDrive(Provider):
    """Options: path of a Parquet file or folder, and the columns for name, modified and text."""

    def pages(self, since: dt.datetime | None) -> Iterable[str]:
        path = self.options["path"]
        for file in [os.path.join(path, f) for f in sorted(os.listdir(path)) if f.endswith(".parquet")] if os.path.isdir(path) else [path]:
            meta = pq.ParquetFile(file).metadata
            at = next(i for i in range(meta.num_columns) if meta.schema.column(i).path == self.options["modified"])
            for g in range(meta.num_row_groups):
                stats = meta.row_group(g).column(at).statistics
                if since is None or stats is None or not stats.has_min_max or stats.max.replace(tzinfo=None) >= since:
                    yield f"{g}:{file}"

    def read(self, page: str, since: dt.datetime | None) -> Iterator[tuple[str, dt.datetime, str]]:
        group, _, file = page.partition(":")
        cols = [self.options[c] for c in ("name", "modified", "text")]
        for batch in pq.ParquetFile(file).iter_batches(row_groups=[int(group)], columns=cols):
            for name, modified, text in zip(*(batch.column(c).to_pylist() for c in cols), strict=True):
                yield str(name), modified.replace(tzinfo=None), text
