"""Lines of text files with a stable number each (S1): a data source whose splits are byte ranges.

A line's number comes from its file's place in the sorted listing and its
first byte's offset, so it needs no shuffle, no window and no second pass, and
does not depend on how files are split.  Adding a file that sorts last keeps all numbers.
"""

from __future__ import annotations

import io

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FIRST_NUMBER = 1 << 62  # numbers start here, away from ids that rows bring with them
OFFSET_BITS = 40        # files up to 1 TiB
FILE_BITS = 22          # 4,194,304 files
SPLIT_BYTES = 128 << 20
BATCH_BYTES = 4 << 20
PACKED = (".gz", ".bz2", ".zst", ".lz4")  # read from their start: such files have no splits


def _file_system(path: str):
    """(file system, path inside it) of a path or URI that pyarrow opens."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:"):]
    return pafs.FileSystem.from_uri(path)


class Ranges(InputPartition):
    """Byte ranges (file number, path, start, end) of one task."""

    def __init__(self, ranges: list):
        super().__init__(ranges)


class LineReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int):
        self.path, self.split_bytes = path, split_bytes

    def _files(self):
        fs, root = _file_system(self.path)
        info = fs.get_file_info(root)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if info.is_file:
            return [info]
        found = fs.get_file_info(pafs.FileSelector(root, recursive=True))
        shown = [i for i in found if i.is_file and i.size and
                 not any(p.startswith(("_", ".")) for p in i.path[len(root):].split("/"))]
        return sorted(shown, key=lambda i: i.path)

    def partitions(self):
        files = self._files()
        if len(files) > 1 << FILE_BITS or any(i.size > 1 << OFFSET_BITS for i in files):
            raise ValueError(f"line numbers hold {1 << FILE_BITS} files of {1 << OFFSET_BITS} bytes")
        tasks, room = [], 0
        for number, info in enumerate(files):
            step = info.size if info.path.endswith(PACKED) else self.split_bytes
            for start in range(0, info.size, step):
                end = min(start + step, info.size)
                if room < end - start:  # small files share a task
                    tasks.append([])
                    room = self.split_bytes
                tasks[-1].append((number, info.path, start, end))
                room -= end - start
        return [Ranges(t) for t in tasks] or [Ranges([])]

    def read(self, partition):
        fs, _ = _file_system(self.path)
        for number, path, start, end in partition.value:
            packed = path.endswith(PACKED)
            source = fs.open_input_stream(path, compression="detect") if packed else fs.open_input_file(path)
            with io.BufferedReader(source, 1 << 20) as f:
                ids, lines, size = [], [], 0
                for at, line in lines_from(f, start, None if packed else end):
                    if not line.strip():
                        continue
                    ids.append(FIRST_NUMBER + (number << OFFSET_BITS) + at)
                    lines.append(line.rstrip(b"\r\n").decode("utf-8", "replace"))
                    size += len(line)
                    if size >= BATCH_BYTES:
                        yield _batch(ids, lines)
                        ids, lines, size = [], [], 0
                if ids:
                    yield _batch(ids, lines)


def lines_from(f, start: int, end: int | None):
    """(offset, line) of the lines whose first byte lies in [start, end); the last one is read to its end."""
    at = start
    if start:
        f.seek(start - 1)
        at = start - 1 + len(f.readline())
    while end is None or at < end:
        line = f.readline()
        if not line:
            return
        yield at, line
        at += len(line)


def _batch(ids: list, lines: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lines, pa.string())], ["number", "line"])


class LineSource(DataSource):
    """Format ``numbered_lines``: option ``path``, and ``split_bytes``."""

    @classmethod
    def name(cls):
        return "numbered_lines"

    def schema(self):
        return "number bigint, line string"

    def reader(self, schema):
        return LineReader(self.options["path"], int(self.options.get("split_bytes", SPLIT_BYTES)))


def read_lines(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(number BIGINT, line STRING) of the non-blank lines of a text file or of all files under a folder.

    Lines end in a line feed.  Files and folders whose name starts with ``_`` or ``.`` are skipped.
    """
    spark.dataSource.register(LineSource)
    return spark.read.format("numbered_lines").option("split_bytes", int(split_bytes)).option("path", path).load()
