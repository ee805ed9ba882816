"""Folders of Arrow shards as a data source: ``spark.read.format("arrow_shards").schema(...).load(folder)``."""

from __future__ import annotations

import glob
import os

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Shard(InputPartition):
    def __init__(self, path: str, first: int, limit: int | None):
        self.path, self.first, self.limit = path, first, limit


def _batches(path: str):
    """Record batches of a shard in the stream format or, failing that, the file format."""
    import pyarrow as pa

    source = pa.memory_map(path)
    try:
        yield from pa.ipc.open_stream(source)
    except pa.ArrowInvalid:
        reader = pa.ipc.open_file(source)
        for i in range(reader.num_record_batches):
            yield reader.get_batch(i)


class _Reader(DataSourceReader):
    def __init__(self, options: dict, names: list[str]):
        self.folder, self.names = options["path"], names
        self.limit = int(options["max_rows"]) if "max_rows" in options else None

    def partitions(self) -> list[InputPartition]:
        """One partition per shard. Row numbers go on from shard to shard, so the rows of each are counted first."""
        paths = sorted(glob.glob(os.path.join(self.folder, "data-*.arrow")))
        if not paths:
            raise FileNotFoundError(f"no data-*.arrow in {self.folder}")
        out, first = [], 0
        for path in paths:
            left = None if self.limit is None else self.limit - first
            if left is not None and left <= 0:
                break
            out.append(_Shard(path, first, left))
            first += sum(b.num_rows for b in _batches(path))
        return out

    def read(self, partition: _Shard):
        at = 0
        for batch in _batches(partition.path):
            columns = [batch.column(n).to_pylist() if n in batch.schema.names else None for n in self.names]
            for i in range(batch.num_rows):
                if partition.limit is not None and at >= partition.limit:
                    return
                yield tuple(partition.first + at if n == "row_idx" and c is None else (None if c is None else c[i]) for n, c in zip(self.names, columns))
                at += 1


class ArrowShards(DataSource):
    """Columns that a shard lacks are null, except ``row_idx``: the number of the row over all shards."""

    @classmethod
    def name(cls) -> str:
        return "arrow_shards"

    def schema(self):
        raise ValueError("give the schema of the shards")

    def reader(self, schema):
        return _Reader(self.options, schema.fieldNames())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArrowShards)
