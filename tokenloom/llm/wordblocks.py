"""Documents as numbers into the word list of their block (operators 11 and 13).

A block is a run of documents that one task reads, closed at a bound of words
or bytes.  Its distinct words are numbered in the order they are met; each document becomes the
sequence of its word numbers.  Blocks are stored once, bucketed by block, so that
whatever is worked out for a word elsewhere returns to the blocks that have the
word, and only that side is shuffled: the positions stay where they are.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import Scratch

BLOCK_WORDS = 1 << 19   # a block closes when it has so many distinct words
BLOCK_BYTES = 32 << 20  # or so many bytes of text; a longer text is a block of its own
GROUP_BYTES = 1 << 19   # texts are split in groups of about this size
LIST_WORDS = 1 << 14    # words of a block in one stored row
MOST_BUCKETS = 20_000

#: words of a group of texts: (offsets of the texts into the words, the words)
Split = Callable[[list[str]], tuple[np.ndarray, pa.Array]]


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers as byte planes, lowest first, as many as the largest value needs."""
    planes = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    cells = np.ascontiguousarray(values, dtype="<u8").view(np.uint8).reshape(-1, 8)
    return bytes([planes]) + cells[:, :planes].T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, dtype=np.uint8, offset=1).reshape(data[0], -1)
    out = np.zeros(planes.shape[1], dtype=np.int64)
    for i, plane in enumerate(planes):
        out |= plane.astype(np.int64) << (8 * i)
    return out


class _Block:
    """Word numbers of the open block, per group of documents."""

    def __init__(self, block: int):
        self.block, self.size, self.bytes = block, 0, 0
        self.numbers: dict[str | None, dict[str, int]] = {}
        self.counts: list[np.ndarray] = []

    def add(self, grp: str | None, words: pa.Array) -> np.ndarray:
        """Numbers of ``words``, new ones for words not met before."""
        coded = words.dictionary_encode()
        known, at = self.numbers.setdefault(grp, {}), []
        for w in coded.dictionary.to_pylist():
            n = known.get(w)
            if n is None:
                n = known[w] = self.size
                self.size += 1
            at.append(n)
        return np.array(at, dtype=np.int64)[coded.indices.to_numpy()] if len(at) else np.zeros(0, np.int64)


def _empty(schema: pa.Schema, n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema],
                                      schema=schema)


def _stored(row: pa.DataType) -> pa.Schema:
    return pa.schema([("block", pa.int64()), ("row", row), ("grp", pa.string()), ("seq", pa.binary()),
                      ("words", pa.list_(pa.string())), ("numbers", pa.binary()), ("counts", pa.binary())])


def _number(split: Split) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def close(b: _Block, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(b.size, dtype=np.int64)
        for c in b.counts:
            counts[:len(c)] += c
        for grp, known in b.numbers.items():
            words, numbers = list(known), np.fromiter(known.values(), dtype=np.int64, count=len(known))
            for at in range(0, len(words), LIST_WORDS):
                part = numbers[at:at + LIST_WORDS]
                yield _empty(schema, 1, block=pa.array([b.block]), grp=pa.array([grp], pa.string()),
                             words=pa.array([words[at:at + LIST_WORDS]], pa.list_(pa.string())),
                             numbers=pa.array([pack(part)], pa.binary()),
                             counts=pa.array([pack(counts[part])], pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, blocks = TaskContext.get().partitionId() << 32, 0
        b, schema = _Block(first), _stored(pa.null())
        for batch in batches:
            rows, grps = batch.column("row"), batch.column("grp").to_pylist()
            schema = _stored(rows.type)
            texts = batch.column("text")
            order = sorted(range(len(grps)), key=lambda i: (grps[i] is not None, grps[i] or ""))
            at = 0
            while at < len(order):
                end, size, group = at, 0, []
                while end < len(order) and grps[order[end]] == grps[order[at]] and (end == at or size < GROUP_BYTES):
                    group.append(texts[order[end]].as_py() or "")
                    size += len(group[-1])
                    end += 1
                offsets, words = split(group)
                numbers = b.add(grps[order[at]], words)
                b.counts.append(np.bincount(numbers, minlength=0))
                if len(b.counts) > 64:
                    total = np.zeros(b.size, dtype=np.int64)
                    for c in b.counts:
                        total[:len(c)] += c
                    b.counts = [total]
                yield _empty(schema, end - at, block=pa.array(np.full(end - at, b.block)),
                             row=rows.take(pa.array(order[at:end])),
                             grp=pa.array([grps[i] for i in order[at:end]], pa.string()),
                             seq=pa.array([pack(numbers[offsets[i]:offsets[i + 1]]) for i in range(end - at)],
                                          pa.binary()))
                b.bytes += size
                at = end
                if b.size >= BLOCK_WORDS or b.bytes >= BLOCK_BYTES:
                    yield from close(b, schema)
                    blocks += 1
                    b = _Block(first + blocks)
        yield from close(b, schema)

    return run


def separator_split(texts: list[str], spaces: bytes, breaks: bytes) -> tuple[np.ndarray, pa.Array]:
    """Words between ASCII ``spaces`` and ``breaks`` with A-Z in lower case, as a ``Split``.

    An empty word stands where a break lies before a word; one may also stand first in a text.
    """
    kind = np.zeros(256, dtype=np.uint8)
    kind[list(spaces)], kind[list(breaks)] = 1, 2
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    counts, words = np.zeros(len(texts), np.int64), []
    at, last = 0, np.frombuffer(breaks, np.uint8)[:1]
    while at < len(texts):
        group, owners, size = [], [], 0
        while at < len(texts) and (not group or size < GROUP_BYTES):
            data = np.frombuffer(texts[at].encode(), dtype=np.uint8)
            begin = 0
            while begin < len(data):  # long texts are cut where a word has ended
                end = min(len(data), begin + GROUP_BYTES)
                while end < len(data) and not kind[data[end]]:
                    ahead = kind[data[end:end + GROUP_BYTES]] > 0
                    end += int(np.argmax(ahead)) if ahead.any() else len(ahead)
                group.append(data[begin:end])
                owners.append(at)
                size += end - begin
                begin = end
                if size >= GROUP_BYTES and begin < len(data):
                    counts += _cut_words(group, owners, kind, fold, last, len(texts), words)
                    group, owners, size = [], [], 0
            at += 1
        if group:
            counts += _cut_words(group, owners, kind, fold, last, len(texts), words)
    return np.concatenate(([0], np.cumsum(counts))), pa.concat_arrays(words) if words else pa.array([], pa.large_string())


def _cut_words(parts: list[np.ndarray], owners: list[int], kind: np.ndarray, fold: np.ndarray, last: np.ndarray,
               texts: int, out: list[pa.Array]) -> np.ndarray:
    """Appends the words of the parts to ``out``; the number of words of each text."""
    joined = np.concatenate([x for p in parts for x in (p, last)])  # a break ends each part
    limits = np.cumsum([0] + [len(p) + 1 for p in parts])
    kinds = kind[joined]
    inside = kinds == 0
    edge = np.diff(inside.astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    broken = np.concatenate(([0], np.cumsum(kinds == 2)))
    before = broken[starts] > np.concatenate(([0], broken[ends[:-1]])) if len(starts) else np.zeros(0, bool)
    # a break before a word is an empty word of its own
    sizes = np.zeros(len(starts) + int(before.sum()), dtype=np.int64)
    place = np.arange(len(starts)) + np.cumsum(before)
    sizes[place] = ends - starts
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    data = fold[joined[inside]].tobytes()
    out.append(pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)))
    upto = np.concatenate(([0], np.cumsum(1 + before)))[np.searchsorted(starts, limits)]
    return np.bincount(owners, weights=np.diff(upto), minlength=texts).astype(np.int64)


def store_blocks(docs: DataFrame, keep: tuple[str, ...], text: str, grp: F.Column, split: Split,
                 scratch: Scratch) -> tuple[DataFrame, DataFrame, int]:
    """(sequences, words, number of buckets) of all documents, from one stored table.

    sequences: block, row (struct of ``keep``), grp, seq (packed word numbers).
    words: block, grp, words, numbers and counts (packed), some rows a block.
    Words of different ``grp`` (null is one of its own) have numbers of their
    own.  A null text is empty; rows are never merged, so equal rows stay separate.
    """
    spark = docs.sparkSession
    row = T.StructType([docs.schema[c] for c in keep])
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("row", row),
                           T.StructField("grp", T.StringType()), T.StructField("seq", T.BinaryType()),
                           T.StructField("words", T.ArrayType(T.StringType())),
                           T.StructField("numbers", T.BinaryType()), T.StructField("counts", T.BinaryType())])
    source = docs.select(F.struct(*[F.col(c) for c in keep]).alias("row"), F.col(text).cast("string").alias("text"),
                         grp.alias("grp"))
    buckets = min(MOST_BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    table = store_bucketed(source.mapInArrow(_number(split), schema), "block", buckets, scratch)
    return (table.where(F.col("seq").isNotNull()).select("block", "row", "grp", "seq"),
            table.where(F.col("words").isNotNull()).select("block", "grp", "words", "numbers", "counts"), buckets)


def store_bucketed(df: DataFrame, column: str, buckets: int, scratch: Scratch) -> DataFrame:
    """``df`` written in buckets of ``column`` to the shared folder and read back.

    A join or cogroup on ``column`` reads the buckets without a shuffle.
    The catalogue entry that the write needs goes at once; the files stay.
    """
    name, path = f"blocks_{uuid.uuid4().hex}", f"{scratch.base}/{scratch.count}"
    scratch.count += 1
    (df.write.format("parquet").option("compression", "zstd").option("path", path)
     .bucketBy(buckets, column).saveAsTable(name))
    table = df.sparkSession.table(name)
    table.schema  # resolved before the entry goes
    df.sparkSession.sql(f"DROP TABLE {name}")
    return table


def word_rows(words: DataFrame, counts: bool = False) -> DataFrame:
    """(grp, word, block, number) and, if asked for, n: one row for each word of each block."""
    lists = {"words": "word", "numbers": "number"} | ({"counts": "n"} if counts else {})
    unpacked = [F.arrow_udf(_unpack_lists, "array<bigint>")(c).alias(c) for c in list(lists)[1:]]
    return (words.select("block", "grp", "words", *unpacked)
            .select("block", "grp", F.explode_outer(F.arrays_zip(*lists)).alias("w"))
            .select("grp", "block", *[F.col(f"w.{c}").alias(a) for c, a in lists.items()]))


def _unpack_lists(column: pa.Array) -> pa.Array:
    parts = [unpack(x) for x in column.to_pylist()]
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))
