"""BPE encoding and decoding over a table of distinct words (operator 11).

Texts are split into words in Spark; a word of the corpus is encoded
once, however often it occurs, and its ids go back to every block of documents
that has it, where the stored positions put them in order.  Decoding joins the
ids with the vocabulary's (id, piece) rows.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import Scratch
from .wordblocks import GROUP_BYTES, pack, store_blocks, unpack, word_rows

TOKENIZER = "byte_bpe_50k.json"
ENCODE_WORDS = 1 << 14   # words handed to the tokenizer at once
RETURN_WORDS = 1 << 17   # words whose ids are gathered before they go back to their blocks
DECODE_ROWS = 64         # lists decoded at once
GATHER_WORDS = 1 << 18   # positions of a block that are put in order at once

_END, _SPACE, _LETTER, _NUMBER, _OTHER, _UNKNOWN = range(6)
_QUOTE, _BLANK = 0x27, 0x20
#: The endings that the word pattern of byte-level BPE cuts off after an apostrophe.
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


class Vocabulary:
    """A byte-level BPE file: its text, special tokens and pieces."""

    def __init__(self, text: str):
        self.text = text
        spec = json.loads(text)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if (spec.get("normalizer") or model.get("type") != "BPE" or pre.get("type") != "ByteLevel"
                or pre.get("add_prefix_space") or not pre.get("use_regex", True) or model.get("dropout")):
            raise ValueError("a byte-level BPE file without normalizer, prefix space and dropout is needed")
        added = spec.get("added_tokens") or []
        if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens must be matched literally")
        self.special = sorted((t["content"] for t in added), key=lambda t: (-len(t), t))
        self._vocab, self._added = model["vocab"], {t["id"]: t["content"] for t in added}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            return cls(f.read())

    def pieces(self) -> list[tuple[int, bytes]]:
        """(id, bytes) of every token; a file writes each byte as one printable character."""
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte = {chr(b): b for b in printable}
        byte |= {chr(0x100 + i): b for i, b in enumerate(sorted(set(range(256)) - set(printable)))}
        rows = {i: bytes(byte[c] for c in p) for p, i in self._vocab.items()}
        rows |= {i: t.encode() for i, t in self._added.items()}
        return sorted(rows.items())


def default_path() -> str:
    import public_tokenizers
    return str(public_tokenizers.path(TOKENIZER))


_loaded: dict[int, object] = {}


def _tokenizer(text: str):
    """The library's tokenizer, one per worker process."""
    key = hash(text)
    if key not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer
        t = Tokenizer.from_str(text)
        t.no_truncation()
        t.no_padding()
        _loaded.clear()
        _loaded[key] = t
    return _loaded[key]


class _Splitter:
    """Words of texts, as the pre-tokenizer of the file cuts them.

    Boundaries are found over arrays of code points.  The class of a character is
    asked of the library the first time the character is met.
    """

    def __init__(self, text: str, special: list[str]):
        self.cut = _tokenizer(text).pre_tokenizer.pre_tokenize_str
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.classes = np.full(0x110000, _UNKNOWN, dtype=np.uint8)

    def _classify(self, codes: np.ndarray) -> np.ndarray:
        found = self.classes[codes]
        if (found == _UNKNOWN).any():
            for code in np.unique(codes[found == _UNKNOWN]):
                c = chr(code)
                self.classes[code] = next((k for k, before in ((_LETTER, "a"), (_NUMBER, "1"), (_OTHER, "!"))
                                           if len(self.cut(before + c)) == 1), _SPACE)
            found = self.classes[codes]
        return found

    def starts(self, codes: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """True where a word starts; ``edges`` are the starts of the pieces, which are cut apart."""
        kind = self._classify(codes)
        before = np.empty_like(kind)
        before[0], before[1:] = _END, kind[:-1]
        before[edges] = _END
        after = np.empty_like(kind)
        after[-1], after[:-1] = _END, kind[1:]
        after[edges[1:] - 1] = _END
        blank = np.zeros(len(codes), dtype=bool)
        blank[1:] = codes[:-1] == _BLANK
        blank &= before != _END
        solid = kind != _SPACE
        # a run starts; a blank before it belongs to it, and the last space of a run stands alone before a word
        start = np.where(solid, (kind != before) & ~blank, (before != _SPACE) | ((after != _END) & (after != _SPACE)))
        quotes = np.flatnonzero((codes == _QUOTE) & start & (before != _OTHER) & (after == _LETTER))
        for q in quotes:
            for ending in _ENDINGS:
                n = len(ending)
                if (q + n < len(codes) and all(codes[q + 1 + i] == ord(c) for i, c in enumerate(ending))
                        and not (before[q + 1:q + 1 + n] == _END).any()):
                    start[q + 1:q + 1 + n] = False
                    if q + 1 + n < len(codes) and kind[q + 1 + n] == _LETTER and before[q + 1 + n] != _END:
                        start[q + 1 + n] = True
                    break
        start[edges] = True
        return start

    def _pieces(self, text: str) -> Iterator[tuple[str, bool]]:
        """(piece, whether it is a special token); long pieces are cut where a run of spaces starts."""
        at = 0
        for m in [*self.special.finditer(text), None] if self.special else [None]:
            end = m.start() if m else len(text)
            while end - at > GROUP_BYTES:
                cut = re.compile(r"[ \n]").search(text, at + GROUP_BYTES, end)
                while cut and self._classify(np.array([ord(text[cut.start() - 1])]))[0] == _SPACE:
                    cut = re.compile(r"[ \n]").search(text, cut.end(), end)
                if not cut:
                    break
                yield text[at:cut.start()], False
                at = cut.start()
            if at < end:
                yield text[at:end], False
            if m:
                yield m.group(), True
                at = m.end()

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, pa.Array]:
        counts, words, group, owners, size = np.zeros(len(texts), np.int64), [], [], [], 0

        def flush():
            nonlocal group, owners, size
            if group:
                n, w = self._words(group)
                np.add.at(counts, owners, n)
                words.append(w)
            group, owners, size = [], [], 0

        for i, text in enumerate(texts):
            for piece in self._pieces(text):
                group.append(piece)
                owners.append(i)
                size += len(piece[0])
                if size >= GROUP_BYTES:
                    flush()
        flush()
        return (np.concatenate(([0], np.cumsum(counts))),
                pa.concat_arrays(words) if words else pa.array([], pa.large_string()))

    def _words(self, pieces: list[tuple[str, bool]]) -> tuple[np.ndarray, pa.Array]:
        """(words of each piece, the words): words tile the pieces, so only their bounds are needed."""
        text = "".join(p for p, _ in pieces)
        codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
        edges = np.cumsum([0] + [len(p) for p, _ in pieces])
        start = self.starts(codes, edges[:-1])
        for i, (_, special) in enumerate(pieces):
            if special:
                start[edges[i] + 1:edges[i + 1]] = False
        at = np.flatnonzero(start)
        width = 1 + (codes > 0x7F).astype(np.uint8) + (codes > 0x7FF) + (codes > 0xFFFF)
        place = np.concatenate(([0], np.cumsum(width, dtype=np.int64)))
        data = text.encode()
        offsets = np.concatenate((place[at], [len(data)])).astype(np.int64)
        words = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data))
        return np.diff(np.searchsorted(at, edges)), words


def _encode_words(sent):
    """Rows (word, block, number), sorted by word, to packed ids by block; each word is encoded once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(sent.value)
        last: tuple[str | None, list[int]] = (None, [])
        held: list[tuple[np.ndarray, np.ndarray, list[list[int]], np.ndarray]] = []
        size = 0

        def give() -> pa.RecordBatch:
            block = np.concatenate([h[0] for h in held])
            number = np.concatenate([h[1] for h in held])
            ids, which, base = [], [], 0
            for _, _, found, index in held:
                which.append(index + base)
                ids += found
                base += len(found)
            which = np.concatenate(which)
            lengths = np.array([len(x) for x in ids], dtype=np.int64)
            begin = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            flat = np.fromiter((t for x in ids for t in x), dtype=np.int64, count=int(lengths.sum()))
            order = np.argsort(block, kind="stable")
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(block[order])) + 1, [len(order)]))
            out = []
            for a, e in zip(cuts[:-1], cuts[1:]):
                rows = order[a:e]
                w = which[rows]
                n = lengths[w]
                out.append((int(block[rows[0]]), pack(number[rows]), pack(n), pack(flat[_ranges(begin[w], n)])))
            return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64())] + [
                pa.array([o[i] for o in out], pa.binary()) for i in (1, 2, 3)], names=["block", "numbers", "sizes", "ids"])

        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column("word").dictionary_encode()  # sorted rows: distinct words in order
            words, found = coded.dictionary.to_pylist(), []
            first = [last[1]] if words[0] == last[0] else []
            for at in range(len(first), len(words), ENCODE_WORDS):
                found += [e.ids for e in tokenizer.encode_batch_fast(words[at:at + ENCODE_WORDS],
                                                                     add_special_tokens=False)]
            found = first + found
            last = words[-1], found[-1]
            held.append((batch.column("block").to_numpy(), batch.column("number").to_numpy(), found,
                         coded.indices.to_numpy().astype(np.int64)))
            size += batch.num_rows
            if size >= RETURN_WORDS:
                yield give()
                held, size = [], 0
        if held:
            yield give()

    return run


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (size[0] of them), then those of begin[1], ..."""
    ends = np.cumsum(size)
    out = np.arange(ends[-1] if len(ends) else 0)
    out += np.repeat(begin - ends + size, size)
    return out


def _gather(docs: pa.Table, words: pa.Table, pieces: tuple[np.ndarray, pa.Array] | None) -> pa.Table:
    """Ids (and texts, with pieces) of a block's documents: the ids of its words, in the order of the positions."""
    numbers = [unpack(x) for x in words.column("numbers").to_pylist()]
    sizes = [unpack(x) for x in words.column("sizes").to_pylist()]
    flat = [unpack(x) for x in words.column("ids").to_pylist()]
    flat = np.concatenate(flat).astype(np.int32) if flat else np.zeros(0, np.int32)
    count = max((int(n.max()) for n in numbers if len(n)), default=-1) + 1
    length, begin = np.zeros(count, np.int64), np.zeros(count, np.int64)
    at = 0
    for n, s in zip(numbers, sizes):
        length[n], begin[n] = s, at + np.cumsum(s) - s
        at += int(s.sum())
    seqs, out, row = docs.column("seq"), [], 0
    rows = docs.column("row").combine_chunks()
    while row < len(seqs):
        part, size, first = [], 0, row
        while row < len(seqs) and (row == first or size < GATHER_WORDS):
            part.append(unpack(seqs[row].as_py()))
            size += len(part[-1])
            row += 1
        sequence = np.concatenate(part)
        n = length[sequence]
        ends = np.concatenate(([0], np.cumsum(n)))
        texts = np.concatenate(([0], np.cumsum([len(p) for p in part])))
        ids = pa.ListArray.from_arrays(pa.array(ends[texts].astype(np.int32)), pa.array(flat[_ranges(begin[sequence], n)]))
        texts = [_decode_lists(ids, *pieces)] if pieces else []
        out.append(pa.RecordBatch.from_arrays([rows.slice(first, row - first), ids, *texts],
                                              names=["row", "ids", "decoded"][:2 + len(texts)]))
    return pa.Table.from_batches(out)


def encode(docs: DataFrame, path: str | None = None, keep: tuple[str, ...] = ("doc_id",), text: str = "text",
           pieces: DataFrame | None = None, scratch: Scratch | None = None) -> DataFrame:
    """(row struct of the ``keep`` columns, ids array<int>): whole texts as ids of a byte-level BPE file.

    With ``pieces`` (id, piece) the ids are decoded in the same pass, to a further column
    ``decoded``, as ``decode`` does for any table.

    Ids are those that the tokenizers library gives for the text without added
    special tokens; a special token's own string in a text is that token.  One row per input
    row: a null or empty text has no ids, equal rows stay separate, an
    empty table gives none.  Keys may be null or repeated and further columns may have any name:
    rows are not matched by them.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "bpe")
    vocabulary = Vocabulary.load(path or default_path())
    sent, special = spark.sparkContext.broadcast(vocabulary.text), vocabulary.special
    split = _lazy_splitter(sent, special)
    sequences, words, _ = store_blocks(docs, keep, text, F.lit(""), split, scratch)
    located = word_rows(words).select("word", "block", "number")
    ids = (located.repartition(F.col("word")).sortWithinPartitions("word")
           .mapInArrow(_encode_words(sent), "block bigint, numbers binary, sizes binary, ids binary"))
    schema = T.StructType([T.StructField("row", sequences.schema["row"].dataType),
                           T.StructField("ids", T.ArrayType(T.IntegerType()))])
    table = None
    if pieces is not None:
        schema, table = schema.add("decoded", T.StringType()), _send(pieces)

    def join(docs: pa.Table, words: pa.Table) -> pa.Table:
        return _gather(docs, words, table and table.value)

    return (sequences.select("block", "row", "seq").groupBy("block").cogroup(ids.groupBy("block"))
            .applyInArrow(join, schema))


def _lazy_splitter(sent, special: list[str]):
    made = []

    def split(texts: list[str]):
        if not made:
            made.append(_Splitter(sent.value, special))
        return made[0](texts)

    return split


def piece_table(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(id int, piece binary) of a vocabulary file."""
    return spark.createDataFrame(Vocabulary.load(path or default_path()).pieces(), "id int, piece binary")


def _send(pieces: DataFrame):
    """(row of each id, pieces), sent to the tasks; as many as the vocabulary file has."""
    table = pieces.select(F.col("id").cast("int"), F.col("piece").cast("binary")).toArrow().combine_chunks()
    place = np.full(max(table.column(0).to_pylist(), default=-1) + 2, -1, dtype=np.int64)
    place[table.column(0).to_numpy()] = np.arange(table.num_rows)
    values = table.column(1).combine_chunks().cast(pa.large_binary())
    return pieces.sparkSession.sparkContext.broadcast((place, values))


def decode(encoded: DataFrame, pieces: DataFrame, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids: each id joined with its (id, piece) row, in order.

    The pieces, as many as the vocabulary file has, go to the tasks; ids
    are dense, so an id finds its piece by place, without leaving its row.  Ids
    without a piece add nothing; bytes that are no UTF-8 become U+FFFD; null and
    empty lists give the empty text.
    """
    sent = _send(pieces)

    def run(column: pa.Array) -> pa.Array:
        return pa.concat_arrays([_decode_lists(column.slice(at, DECODE_ROWS), *sent.value)
                                 for at in range(0, len(column), DECODE_ROWS)] or [pa.array([], pa.string())])

    return encoded.withColumn(out, F.arrow_udf(run, "string")(F.col(ids)))


def _decode_lists(ids: pa.Array, place: np.ndarray, values: pa.Array) -> pa.Array:
    flat = ids.flatten().to_numpy(zero_copy_only=False)
    known = (flat >= 0) & (flat < len(place) - 1)
    row = np.where(known, place[np.where(known, flat, 0)], -1)
    sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
    kept = np.concatenate(([0], np.cumsum(row >= 0)))[np.concatenate(([0], np.cumsum(sizes)))]
    texts = pc.take(values, pa.array(row[row >= 0]))
    if not len(texts):
        return pa.array([""] * len(ids), pa.string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=len(texts) + 1)
    bounds, data = offsets[kept], texts.buffers()[2] or pa.py_buffer(b"")
    whole = pa.StringArray.from_buffers(len(ids), pa.py_buffer(bounds.astype(np.int32).tobytes()), data)
    try:
        whole.validate(full=True)
        return whole
    except pa.ArrowInvalid:  # some row is no UTF-8
        data = data.to_pybytes()
        return pa.array([data[a:e].decode("utf-8", "replace") for a, e in zip(bounds[:-1], bounds[1:])], pa.string())


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256 of the encoded and decoded whole text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    coded = encode(docs, pieces=piece_table(spark))
    return coded.select(F.col("row.doc_id").alias("doc_id"), F.size("ids").cast("bigint").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
