"""A pluggable source as a Python data source: read whole, past a mark, or as a stream.

A client knows a store whose rows carry a growing mark (a number or time in microseconds).  It
lists slices of a range of marks, small values that travel to tasks, and reads one slice as Arrow
batches.  Registered under a name, the same client serves ``spark.read`` and ``spark.readStream``;
a filter on the mark narrows the slices, and a stream's offset is the mark.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, GreaterThan, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

BEFORE_ALL = -(1 << 62)
BATCH_ROWS, BUFFER_BYTES = 256, 1 << 20  # what a task holds of a row group, however large that is


class Client(Protocol):
    """What a store has to offer.  ``after`` is exclusive, ``upto`` inclusive; None means the end."""

    mark: str  # name of the mark column

    def schema(self) -> StructType: ...

    def newest(self) -> int | None: ...

    def slices(self, after: int | None, upto: int | None) -> list[Any]: ...

    def rows(self, part: Any, after: int | None, upto: int | None) -> Iterator[pa.RecordBatch]: ...


class ParquetClient:
    """Parquet files under a path or URI: a slice is a few row groups of one file.

    Row groups whose statistics lie outside the range are not listed.  Rows with a null mark are
    read only when no bound is given, as no stream can tell them from rows already taken.
    """

    def __init__(self, path: str, mark: str, groups: int = 1) -> None:
        self.path, self.mark, self.groups = path, mark, groups

    def _open(self) -> tuple[pafs.FileSystem, list[str]]:
        files, path = pafs.FileSystem.from_uri(self.path) if "://" in self.path else (pafs.LocalFileSystem(), self.path)
        if files.get_file_info(path).type == pafs.FileType.Directory:
            found = files.get_file_info(pafs.FileSelector(path, recursive=True))
            return files, sorted(f.path for f in found if f.path.endswith(".parquet"))
        return files, [path]

    def schema(self) -> StructType:
        files, paths = self._open()
        return from_arrow_schema(pq.read_schema(paths[0], filesystem=files).remove_metadata())

    def _groups(self) -> Iterator[tuple[str, int, int | None, int | None]]:
        """(file, row group, smallest mark, largest mark), None where the file does not say."""
        files, paths = self._open()
        for path in paths:
            about = pq.read_metadata(path, filesystem=files)
            column = about.schema.names.index(self.mark)
            for g in range(about.num_row_groups):
                known = about.row_group(g).column(column).statistics
                yield path, g, *((known.min, known.max) if known and known.has_min_max else (None, None))

    def newest(self) -> int | None:
        return max((high for _, _, _, high in self._groups() if high is not None), default=None)

    def slices(self, after: int | None, upto: int | None) -> list[tuple[str, list[int]]]:
        out: list[tuple[str, list[int]]] = []
        for path, g, low, high in self._groups():
            if (after is not None and high is not None and high <= after) or (upto is not None and low is not None and low > upto):
                continue
            if out and out[-1][0] == path and len(out[-1][1]) < self.groups:
                out[-1][1].append(g)
            else:
                out.append((path, [g]))
        return out

    def rows(self, part: tuple[str, list[int]], after: int | None, upto: int | None) -> Iterator[pa.RecordBatch]:
        files, _ = self._open()
        with pq.ParquetFile(part[0], filesystem=files, buffer_size=BUFFER_BYTES, pre_buffer=False) as file:
            for batch in file.iter_batches(BATCH_ROWS, row_groups=part[1], use_threads=False):
                keep = None
                for bound, passes in ((after, pc.greater), (upto, pc.less_equal)):
                    if bound is not None:
                        fits = passes(batch.column(self.mark), bound)
                        keep = fits if keep is None else pc.and_(keep, fits)
                yield batch if keep is None else batch.filter(keep)


class Slice(InputPartition):
    def __init__(self, value: Any, after: int | None, upto: int | None) -> None:
        super().__init__(pickle.dumps((value, after, upto)))


def _read(client: Client, partition: InputPartition) -> Iterator[pa.RecordBatch]:
    value, after, upto = pickle.loads(partition.value)
    yield from client.rows(value, after, upto)


class _Batch(DataSourceReader):
    def __init__(self, client: Client, after: int | None, upto: int | None) -> None:
        self.client, self.after, self.upto = client, after, upto

    def pushFilters(self, filters):
        """Takes ``mark > value`` over; Spark applies all other filters itself."""
        for f in filters:
            if isinstance(f, GreaterThan) and f.attribute == (self.client.mark,):
                self.after = f.value if self.after is None else max(self.after, f.value)
            else:
                yield f

    def partitions(self):
        return [Slice(s, self.after, self.upto) for s in self.client.slices(self.after, self.upto)]

    def read(self, partition):
        return _read(self.client, partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, client: Client, after: int | None) -> None:
        self.client, self.after = client, after

    def initialOffset(self):
        return {"mark": BEFORE_ALL if self.after is None else self.after}

    def latestOffset(self):
        newest = self.client.newest()
        return {"mark": self.initialOffset()["mark"] if newest is None else newest}

    def partitions(self, start, end):
        return [Slice(s, start["mark"], end["mark"]) for s in self.client.slices(start["mark"], end["mark"])]

    def read(self, partition):
        return _read(self.client, partition)

    def commit(self, end):
        """Marks only grow, so nothing is kept for offsets already taken."""


def register(spark: SparkSession, name: str, connect: Callable[[dict[str, str]], Client]) -> None:
    """Make ``connect(options)`` readable as format ``name``; the options ``after`` and ``upto``
    bound the marks (a stream takes ``after`` alone).  Connecting again under a name replaces it."""

    class Connected(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def _bound(self, key: str) -> int | None:
            return int(self.options[key]) if key in self.options else None

        def schema(self) -> StructType:
            return connect(dict(self.options)).schema()

        def reader(self, schema: StructType) -> DataSourceReader:
            return _Batch(connect(dict(self.options)), self._bound("after"), self._bound("upto"))

        def streamReader(self, schema: StructType) -> DataSourceStreamReader:
            return _Stream(connect(dict(self.options)), self._bound("after"))

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Connected)
