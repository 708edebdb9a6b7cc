"""Subword vocabularies (P5, P6, P16): encode and decode with a loaded byte-level BPE file.

The file is given, never trained here: a model's ids are fixed by the
vocabulary it was made with.  Encoding is lossless -- every byte has a
token, so there is no unknown id and decoding gives the text back.  Rows
are encoded where they are read, in Arrow batches; the file is sent to the
tasks once and opened once per Python worker.
"""

from __future__ import annotations

import json
import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import bound_batches
from .vocab import _list_like

ENCODE_BYTES = 1 << 20  # texts handed to the library at once

_open: dict[int, object] = {}


def _tokenizer(text: str):
    """The library's tokenizer for a file's text, one per Python worker."""
    key = hash(text)
    if key not in _open:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        made = Tokenizer.from_str(text)
        made.no_truncation()
        made.no_padding()
        _open.clear()
        _open[key] = made
    return _open[key]


def default_vocabulary() -> str:
    """Path of the public byte-level file that the queries use."""
    import public_tokenizers
    return str(public_tokenizers.path("byte_bpe_50k.json"))


def _read(path: str | None) -> str:
    with open(path or default_vocabulary(), encoding="utf-8") as f:
        return f.read()


def vocabulary(spark: SparkSession, path: str | None = None) -> DataFrame:
    """P5: (id INT, piece BINARY, special BOOLEAN) of a byte-level file, one row per id."""
    spec = json.loads(_read(path))
    if (spec.get("decoder") or {}).get("type") != "ByteLevel":
        raise ValueError("the file is not byte-level")
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
    rows = {i: (bytes(byte[c] for c in piece), False) for piece, i in spec["model"]["vocab"].items()}
    rows |= {t["id"]: (t["content"].encode(), True) for t in spec.get("added_tokens") or []}
    return spark.createDataFrame([(i, *rows[i]) for i in sorted(rows)], "id int, piece binary, special boolean")


def encode_subwords(docs: DataFrame, path: str | None = None, max_length: int | None = None, text: str = "text",
                    id_col: str = "doc_id", keep: tuple = ()) -> DataFrame:
    """P6 (+P7): (id_col, keep..., ids ARRAY<INT>) of whole texts, or of their first ``max_length`` ids.

    Ids are the library's for the text without added special tokens.  A
    null or empty text has no ids.
    """
    bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(_read(path))

    def run(texts: pa.Array) -> pa.Array:
        tokenizer, ids, sizes, group, size = _tokenizer(sent.value), [], [], [], 0

        def flush():
            for e in tokenizer.encode_batch_fast(group, add_special_tokens=False):
                ids.append(pa.array(e.ids[:max_length], pa.int32()))
                sizes.append(len(ids[-1]))

        for t in texts:
            group.append(t.as_py() or "")
            size += len(group[-1])
            if size >= ENCODE_BYTES:
                flush()
                group, size = [], 0
        flush()
        offsets = [0]
        for n in sizes:
            offsets.append(offsets[-1] + n)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.concat_arrays(ids or [pa.array([], pa.int32())]))

    return docs.select(id_col, *keep, F.arrow_udf(run, "array<int>")(F.col(text).cast("string")).alias("ids"))


def decode_subwords(ids: DataFrame, vocab: DataFrame, col: str = "ids", id_col: str = "doc_id",
                    skip_special: bool = True) -> DataFrame:
    """(id_col, text): the pieces' bytes put together, read as UTF-8 (broken bytes become U+FFFD).

    The vocabulary goes to the tasks (as many rows as its file has); ids
    that it lacks, and special ones unless asked for, are skipped.
    """
    bound_batches(ids.sparkSession)
    chosen = vocab.where(~F.col("special")) if skip_special else vocab
    table = chosen.select("id", "piece").toArrow().combine_chunks()
    sent = vocab.sparkSession.sparkContext.broadcast(tuple(c.combine_chunks() for c in table.columns))

    def run(lists: pa.Array) -> pa.Array:
        import pyarrow.compute as pc
        known, pieces = sent.value
        found = _list_like(lists, pc.take(pieces, pc.index_in(lists.flatten(), value_set=known)))
        return pa.array([b"".join(p for p in row if p is not None).decode("utf-8", "replace")
                         for row in (x.as_py() for x in found)], pa.string())

    return ids.select(id_col, F.arrow_udf(run, "string")(F.col(col).cast("array<int>")).alias("text"))


def subword_counts(ids: DataFrame, vocab: DataFrame, col: str = "ids") -> DataFrame:
    """Occurrences of every id of the vocabulary: (id, piece, special, count), 0 for ids that never occur."""
    used = (ids.select(F.explode_outer(col).alias("id")).where(F.col("id").isNotNull())
            .groupBy("id").agg(F.count(F.lit(1)).alias("count")))
    return vocab.join(used, "id", "left").select("id", "piece", "special", F.coalesce("count", F.lit(0)).alias("count"))
