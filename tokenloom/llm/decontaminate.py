"""Benchmark decontamination with Aho-Corasick (operator 1).

Benchmark texts are normalised (A-Z lower-cased, words of digits, letters and
all non-ASCII characters, one space between words) and cut into windows of ten
words.  One automaton holds every window.  Each document is normalised the same
way and scanned once; a match of the automaton, bounded by spaces, is a run of
whole words, and its words map back to character offsets of the original text.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import Scratch, fresh_name
from .textops import as_bytes

WINDOW = 10
BLOCK_CHARS = 32_000_000  # characters of windows in one automaton; more windows go to further scans
BATCH_TEXTS = 256

_FOLD = bytes(x + 32 if 65 <= x <= 90 else x if 48 <= x <= 57 or 97 <= x <= 122 or x >= 128 else 32
              for x in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
HITS = ("struct<n_words:bigint,n_hit:bigint,items:array<string>,"
        "spans:array<struct<start:bigint,end:bigint,first:bigint,last:bigint>>>")
ARROW_HITS = pa.struct([
    ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
    ("spans", pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "end", "first", "last")])))])


def normalise(text: bytes) -> bytes:
    """Words in lower case, each with one space before and after it."""
    return b" " + b" ".join(text.translate(_FOLD).split()) + b" "


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """(window, items): every window of ``size`` words, and the ids of the items that have it.

    An item of fewer words, but not none, is one window.  Items without words
    or with a null text have none.  A null id has no place in ``items``, but its windows count.
    """
    lower = F.translate(F.col(text).cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = items.select(F.col(item_id).cast("string").alias("i"),
                         F.regexp_extract_all(lower, F.lit(f"({WORD_PATTERN})"), F.lit(1)).alias("w"))
    last = F.greatest(F.lit(1), F.size("w") - F.lit(size - 1))
    at = words.where(F.size("w") > 0).select("i", "w", F.explode(F.sequence(F.lit(1), last)).alias("p"))
    return (at.select("i", F.array_join(F.slice("w", F.col("p"), F.lit(size)), " ").alias("window"))
            .groupBy("window").agg(F.collect_set("i").alias("items")))


def build_automaton(windows: list[tuple[str, list[str]]]):
    """Automaton over ' w1 w2 ... '; a window's value is (its length, its words, its items)."""
    machine = ahocorasick.Automaton()
    for window, items in windows:
        key = f" {window} ".encode().decode("latin-1")
        machine.add_word(key, (len(key), window.count(" ") + 1, items))
    machine.make_automaton()
    return machine


def _spans(text: bytes, hit: np.ndarray) -> list[dict]:
    """Runs of hit words: word numbers and character offsets in the original text, ends exclusive."""
    at = [m.span() for m in _WORD.finditer(text)]
    edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    chars = np.concatenate(([0], np.cumsum((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80)))
    return [{"start": int(chars[at[s][0]]), "end": int(chars[at[e - 1][1]]), "first": int(s), "last": int(e)}
            for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]


def scan(text: bytes, machine, before: dict | None = None) -> dict:
    """Hits of one text; ``before`` has the hits of an earlier automaton on the same text."""
    norm = normalise(text)
    n_words = 0 if len(norm) == 2 else norm.count(b" ") - 1
    found = list(machine.iter(norm.decode("latin-1"))) if n_words and len(machine) else []
    items = set(before["items"]) if before else set()
    if not found and not (before and before["spans"]):
        return {"n_words": n_words, "n_hit": 0, "items": sorted(items), "spans": []}
    gap = np.cumsum(np.frombuffer(norm, dtype=np.uint8) == 32)
    change = np.zeros(n_words + 1, dtype=np.int64)
    for end, (length, words, ids) in found:
        first = int(gap[end - length + 1]) - 1
        change[first] += 1
        change[first + words] -= 1
        items.update(ids)
    for run in before["spans"] if before else []:
        change[run["first"]] += 1
        change[run["last"]] -= 1
    hit = np.cumsum(change)[:n_words] > 0
    return {"n_words": n_words, "n_hit": int(hit.sum()), "items": sorted(items), "spans": _spans(text, hit)}


_machines: dict[str, object] = {}


def _scanner(windows, name: str):
    """Texts -> hits; the automaton of a block is built once in a Python worker."""
    def run(texts: pa.Array, before: pa.Array) -> pa.Array:
        if name not in _machines:
            _machines.clear()
            _machines[name] = build_automaton(windows.value)
        out = []
        for at in range(0, len(texts), BATCH_TEXTS):
            earlier = before.slice(at, BATCH_TEXTS).to_pylist()
            out += [scan(t, _machines[name], e) for t, e in zip(as_bytes(texts.slice(at, BATCH_TEXTS)), earlier)]
        return pa.array(out, ARROW_HITS)
    return F.arrow_udf(run, HITS)


def find_contamination(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id",
                       item_text: str = "text", size: int = WINDOW, block_chars: int = BLOCK_CHARS) \
        -> tuple[DataFrame, str]:
    """(docs with one more column, its name): struct of n_words, n_hit, items, spans.

    Every input column stays; the new one gets a name that clashes with none.
    A null text has no words.  Spans are runs of hit words: character offsets
    (start, end) and word numbers (first, last), ends exclusive.  No benchmark
    item, or none with words, leaves every document clean.  Repeated rows are
    each scanned.  The windows of a benchmark of up to ``block_chars``
    characters make one automaton; a larger benchmark is split by hash into
    blocks of about that size, each broadcast and scanned in turn, with a
    stored table between two scans.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    windows, path = scratch.store(item_windows(items, item_id, item_text, size))
    total = windows.agg(F.sum(F.length("window"))).first()[0] or 0
    blocks = max(1, -(-total // block_chars))
    name = fresh_name(docs.columns, "contamination")
    out = docs.withColumn(name, F.lit(None).cast(HITS))
    for block in range(blocks):
        part = windows.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == block)
        held = spark.sparkContext.broadcast([(r["window"], r["items"]) for r in part.collect()])
        scanner = _scanner(held, f"{path}-{block}")
        if block:
            out, _ = scratch.store(out)
        out = out.withColumn(name, scanner(F.col(text).cast("string"), F.col(name)))
    return out, name


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs``, unchanged, that hold no window of any item."""
    marked, name = find_contamination(docs, items, text)
    return marked.where(F.col(f"{name}.n_hit") == 0).drop(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    marked, name = find_contamination(docs, items)
    hits = F.col(name)
    return marked.select(
        "doc_id", hits["n_words"].alias("n_words"), hits["n_hit"].alias("n_hit"),
        F.size(hits["items"]).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(hits["items"], ","), 256).alias("items_sha256"),
        (hits["n_hit"] > 0).alias("contaminated"))
