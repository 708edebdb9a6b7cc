"""Phrase collocation mining by direct-address tiling (operator 13).

Words that are frequent enough get ids by rank of frequency.  The plane of id
pairs is cut into tiles: those of the most frequent words are small and dense and are counted by
address; the others hold sorted (cell, count) lists.  Blocks of documents count their own tiles, and
the tiles' lists are added up over all blocks.  Frequent pairs are ranked in turn: blocks list
what follows their likely pairs under the pairs' tiles, and where the lists of a tile meet, its frequent
pairs take their ranks as ids and the cells (ranked pair, word) are counted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.rank import global_rank
from .storage import Scratch
from .wordblocks import pack, separator_split, store_blocks, unpack, word_rows

LEAST = 10          # occurrences that make a phrase a candidate
TOP = 2000          # phrases given per group
MILLION = 1_000_000
ABSORBED = 50       # a phrase goes if a longer one has this percentage of its occurrences
HEAD = 1 << 11      # ids whose pairs are counted by address
STRIPE = 1 << 8     # first ids of a head tile
FAN = 1 << 7        # lists of one tile that are added up at once
SPLIT_BLOCKS = 1 << 5   # so many blocks add one more split of the tiles outside the head
SKETCH_BITS = 1 << 27   # of the set of frequent pairs; it spares work and never decides
TOP_SALTS = 1 << 6

TRIPLES = "grp string, tile bigint, salt bigint, codes binary, thirds binary, counts binary"
PACKS = "grp string, tile bigint, salt bigint, codes binary, counts binary"


# --- tiles ----------------------------------------------------------------------------------------

def _octave(i: np.ndarray) -> np.ndarray:
    return np.frexp(i.astype(np.float64))[1] - 1


_HEAD_STRIPES = HEAD // STRIPE
_HEAD_OCTAVE = HEAD.bit_length() - 1


def _stripe(i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(stripe, first id of it) of first ids: fixed widths in the head, then four stripes an octave."""
    o = np.maximum(_octave(np.maximum(i, 1)), _HEAD_OCTAVE)
    quarter = (i >> (o - 2)) & 3
    low = np.where(i < HEAD, i // STRIPE * STRIPE, (4 + quarter) << (o - 2))
    return np.where(i < HEAD, i // STRIPE, _HEAD_STRIPES + (o - _HEAD_OCTAVE) * 4 + quarter), low


def _band(j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(band, first id of it) of second ids: the head, then an octave each; a band is as wide as it starts high."""
    o = np.maximum(_octave(np.maximum(j, 1)), _HEAD_OCTAVE)
    return np.where(j < HEAD, 0, o - _HEAD_OCTAVE + 1), np.where(j < HEAD, 0, 1 << o)


def _corner(tile: int, splits: int) -> tuple[int, int, int]:
    """(first row id, first column id, width) of a tile."""
    stripe, band = divmod(tile // splits, 64)
    if stripe < _HEAD_STRIPES:
        row = stripe * STRIPE
    else:
        o, quarter = divmod(stripe - _HEAD_STRIPES, 4)
        row = (4 + quarter) << (o + _HEAD_OCTAVE - 2)
    column = 0 if band == 0 else 1 << (band - 1 + _HEAD_OCTAVE)
    return row, column, column or HEAD


def tile_lists(a: np.ndarray, b: np.ndarray, splits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(tile, sorted cells, counts) of the pairs (a[p], b[p])."""
    head = (a < HEAD) & (b < HEAD)
    dense = np.bincount(a[head] * HEAD + b[head])
    cells = np.flatnonzero(dense)
    code, n = np.unique((a[~head] << 32) | b[~head], return_counts=True)
    a, b = np.concatenate((cells // HEAD, code >> 32)), np.concatenate((cells % HEAD, code & 0xFFFFFFFF))
    n = np.concatenate((dense[cells], n))
    tile, cell = _address(a, b, splits)
    order = np.lexsort((cell, tile))
    tile, cell, n = tile[order], cell[order], n[order]
    for s, e in _runs(tile):
        yield int(tile[s]), cell[s:e], n[s:e]


def _address(a: np.ndarray, b: np.ndarray, splits: int) -> tuple[np.ndarray, np.ndarray]:
    """(tile, cell in it) of pairs."""
    (stripe, row), (band, column) = _stripe(a), _band(b)
    tile = (stripe * 64 + band) * splits + np.where(stripe < _HEAD_STRIPES, 0, a % splits)
    return tile, (a - row) * np.maximum(column, HEAD) + b - column


def _runs(sorted_keys: np.ndarray) -> Iterator[tuple[int, int]]:
    if len(sorted_keys):
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(sorted_keys)) + 1, [len(sorted_keys)]))
        yield from zip(cuts[:-1].tolist(), cuts[1:].tolist())


def add_lists(tile: int, splits: int, cells: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The sum of sorted lists of one tile: by address in a dense tile, else by one sort."""
    if tile // splits // 64 < _HEAD_STRIPES and tile // splits % 64 == 0:
        total = np.zeros(STRIPE * HEAD, dtype=np.int64)
        for c, n in zip(cells, counts):
            total[c] += n
        found = np.flatnonzero(total)
        return found, total[found]
    cell, n = np.concatenate(cells), np.concatenate(counts)
    order = np.argsort(cell, kind="stable")
    cell, n = cell[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    return cell[first], np.add.reduceat(n, first)


def _packed(rows: list[tuple]) -> pa.Table:
    """Rows (grp, tile, salt, cells, counts) as a table of packed lists."""
    return pa.table({"grp": pa.array([r[0] for r in rows], pa.string()), "tile": pa.array([r[1] for r in rows], pa.int64()),
                     "salt": pa.array([r[2] for r in rows], pa.int64()),
                     "codes": pa.array([pack(np.diff(r[3], prepend=0)) for r in rows], pa.binary()),
                     "counts": pa.array([pack(r[4]) for r in rows], pa.binary())})


def _unpacked(table: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray]]:
    return ([np.cumsum(unpack(c)) for c in table.column("codes").to_pylist()],
            [unpack(c) for c in table.column("counts").to_pylist()])


def add_tiles(packs: DataFrame, blocks: int, splits: int, least: int, scratch: Scratch) -> DataFrame:
    """(grp, tile, a, b, n) of the cells with n >= least; at most about FAN lists of a tile meet in one group."""
    def some(table: pa.Table) -> pa.Table:
        tile = table.column("tile")[0].as_py()
        cells, n = add_lists(tile, splits, *_unpacked(table))
        return _packed([(table.column("grp")[0].as_py(), tile, table.column("salt")[0].as_py(), cells, n)])

    def last(table: pa.Table) -> pa.Table:
        tile = table.column("tile")[0].as_py()
        cells, n = add_lists(tile, splits, *_unpacked(table))
        cells, n = cells[n >= least], n[n >= least]
        row, column, width = _corner(tile, splits)
        grp = table.column("grp")[0].as_py()
        return pa.table({"grp": pa.array([grp] * len(n), pa.string()), "tile": pa.array([tile] * len(n), pa.int64()),
                         "a": pa.array(row + cells // width, pa.int64()),
                         "b": pa.array(column + cells % width, pa.int64()), "n": pa.array(n, pa.int64())})

    packs = _in_rounds(packs, blocks, some, PACKS, scratch)
    return packs.groupBy("grp", "tile").applyInArrow(last, "grp string, tile bigint, a bigint, b bigint, n bigint")


def _in_rounds(packs: DataFrame, blocks: int, add, schema: str, scratch: Scratch) -> DataFrame:
    """Lists of ``blocks`` blocks added up until about FAN lists of a tile are left at most."""
    while blocks > FAN:
        blocks = -(-blocks // FAN)
        packs = packs.withColumn("salt", F.pmod("salt", F.lit(blocks)))
        packs, _ = scratch.store(packs.groupBy("grp", "tile", "salt").applyInArrow(add, schema))
    return packs


def _triple_pack(grp: str, tile: int, salt: int, cell: np.ndarray, third: np.ndarray, n: np.ndarray) -> tuple:
    return grp, tile, salt, pack(np.diff(cell, prepend=0)), pack(third), pack(n)


def _triple_table(rows: list[tuple]) -> pa.Table:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.table({c: pa.array([r[i] for r in rows], k)
                     for i, (c, k) in enumerate(zip(("grp", "tile", "salt", "codes", "thirds", "counts"), kinds))})


def _sum_sorted(high: np.ndarray, low: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct (high, low) with their summed counts."""
    order = np.lexsort((low, high))
    high, low, n = high[order], low[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])))) if len(n) else order
    return high[first], low[first], np.add.reduceat(n, first) if len(n) else n


def _triple_lists(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (np.concatenate([np.cumsum(unpack(c)) for c in table.column("codes").to_pylist()]),
            *(np.concatenate([unpack(c) for c in table.column(k).to_pylist()]) for k in ("thirds", "counts")))


def add_triples(packs: DataFrame, pairs: DataFrame, blocks: int, splits: int, least: int, scratch: Scratch) -> DataFrame:
    """(grp, pair, c, n) of the ranked pairs that word c follows, n >= least.

    ``packs`` list pairs by their cells.  Where a tile's lists meet, its frequent pairs (grp, tile, a, b, id) take
    their ranks as new ids and the others go; the (ranked pair, word) cells are counted there.
    """
    def some(table: pa.Table) -> pa.Table:
        key = [table.column(c)[0].as_py() for c in ("grp", "tile", "salt")]
        return _triple_table([_triple_pack(*key, *_sum_sorted(*_triple_lists(table)))])

    def last(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("grp", pa.string()), ("pair", pa.int64()), ("c", pa.int64()), ("n", pa.int64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        grp, tile = left.column("grp")[0].as_py(), left.column("tile")[0].as_py()
        cell, third, n = _triple_lists(left)
        row, column, width = _corner(tile, splits)
        known = (right.column("a").to_numpy() - row) * width + right.column("b").to_numpy() - column
        order = np.argsort(known)
        known, rank = known[order], right.column("id").to_numpy()[order]
        at = np.minimum(np.searchsorted(known, cell), len(known) - 1)
        kept = known[at] == cell
        pair, third, n = _sum_sorted(rank[at[kept]], third[kept], n[kept])
        pair, third, n = (x[n >= least] for x in (pair, third, n))
        return pa.table({"grp": pa.array([grp] * len(n), pa.string()), "pair": pair, "c": third, "n": n}, schema=schema)

    packs = _in_rounds(packs, blocks, some, TRIPLES, scratch)
    return (packs.groupBy("grp", "tile").cogroup(pairs.select("grp", "tile", "a", "b", "id").groupBy("grp", "tile"))
            .applyInArrow(last, "grp string, pair bigint, c bigint, n bigint"))


# --- blocks ---------------------------------------------------------------------------------------

def _split_pieces(texts: list[str]) -> tuple[np.ndarray, pa.Array]:
    return separator_split(texts, spaces=b" \t", breaks=b".,;:!?\n\x0b\x0c\r")


def _ranked_sequences(docs: pa.Table, known: pa.Table) -> Iterator[tuple[str, np.ndarray]]:
    """(grp, word ids of the block's texts of that group); -1 for a break, another word, a text's end."""
    number, rank = (known.column(c).to_numpy() if known.num_rows else np.zeros(0, np.int64) for c in ("number", "id"))
    grps: dict[str, list[int]] = {}
    for i, g in enumerate(docs.column("grp").to_pylist()):
        grps.setdefault(g, []).append(i)
    lookup = np.full(int(number.max(initial=-1)) + 2, -1, dtype=np.int64)
    lookup[number] = rank
    end = np.array([len(lookup) - 1])
    seqs = docs.column("seq")
    for g, rows in grps.items():
        parts = [x for i in rows for x in (unpack(seqs[i].as_py()), end)]
        sequence = np.concatenate(parts)
        yield g, lookup[np.minimum(sequence, len(lookup) - 1)]


def _pairs(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    whole = (ids[:-1] >= 0) & (ids[1:] >= 0)
    return ids[:-1][whole], ids[1:][whole]


def _count_pairs(splits: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    def run(key: tuple, docs: pa.Table, known: pa.Table) -> pa.Table:
        salt = crc32(str(key[0].as_py()).encode())
        return _packed([(g, t, salt, c, n) for g, ids in _ranked_sequences(docs, known)
                        for t, c, n in tile_lists(*_pairs(ids), splits)])

    return run


def _place(grp: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * 1_000_003 + b * 7_919 + crc32(grp.encode())) % SKETCH_BITS


def _place_col(grp: Column, a: Column, b: Column) -> Column:
    return (a * 1_000_003 + b * 7_919 + F.crc32(F.encode(grp, "utf-8"))) % SKETCH_BITS


def _count_triples(splits: int, sketch) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """Three words whose two pairs may both be frequent by the sketch, listed in the tile of the first pair."""
    def run(key: tuple, docs: pa.Table, known: pa.Table) -> pa.Table:
        bits, salt, rows = sketch.value, crc32(str(key[0].as_py()).encode()), []
        for g, ids in _ranked_sequences(docs, known):
            whole = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
            at = _place(g, ids[whole], ids[whole + 1])
            likely = np.zeros(len(ids), dtype=bool)
            likely[whole] = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            start = np.flatnonzero(likely[:-1] & likely[1:])
            a, b, c = ids[start], ids[start + 1], ids[start + 2] if len(start) else ids[:0]
            tile, cell = _address(a, b, splits)
            order = np.argsort(tile, kind="stable")
            tile, cell, c = tile[order], cell[order], c[order]
            for s, e in _runs(tile):
                rows.append(_triple_pack(g, int(tile[s]), salt, *_sum_sorted(cell[s:e], c[s:e], np.ones(e - s, np.int64))))
        return _triple_table(rows)

    return run


# --- ranks and phrases ----------------------------------------------------------------------------

def _ranked(counts: DataFrame, tie: Column) -> DataFrame:
    """``counts`` (grp, n, ...) with id = 0, 1, ... by n descending, then tie, per grp."""
    order = F.concat(F.lpad(F.hex(F.lit(2 ** 62) - F.col("n")), 16, "0"), F.hex(tie))
    return global_rank(counts.withColumn("_o", order), "_o", "_o", bucket=F.substring("_o", 1, 18), partition_cols=("grp",),
                       total_col=None, rank_col="id").drop("_o")


def _sketch(pairs: DataFrame):
    """Bits of the pairs' places, of fixed size, sent to the tasks."""
    place = _place_col(F.col("grp"), F.col("a"), F.col("b")) + 1  # bitmap places start at 1
    rows = pairs.select(F.bitmap_bucket_number(place).alias("k"), F.bitmap_bit_position(place).alias("bit"))
    rows = rows.groupBy("k").agg(F.bitmap_construct_agg("bit").alias("bits")).toArrow()
    bits = np.zeros(SKETCH_BITS // 8, dtype=np.uint8)
    for k, part in zip(rows.column("k").to_pylist(), rows.column("bits").to_pylist()):
        data = np.frombuffer(part, dtype=np.uint8)
        bits[(k - 1) * len(data):k * len(data)] = data
    return pairs.sparkSession.sparkContext.broadcast(bits)


def _score(a: str, left: str, right: str) -> Column:
    """floor(10^6 a^2 / (left right)), exact; not above 10^6, since no part is rarer than the phrase."""
    a, left, right = (f"CAST({c} AS DECIMAL(14,0))" for c in (a, left, right))
    return F.expr(f"({a} * {a} * CAST({MILLION} AS DECIMAL(7,0))) div ({left} * {right})")


def collocations(docs: DataFrame, text: str = "text", group: str = "lang", least: int = LEAST, top: int = TOP,
                 scratch: Scratch | None = None) -> DataFrame:
    """(grp, rank, phrase, a, l, r, n, score): the best phrases of two and three words of each group.

    Counts are exact and cover all texts: n words of the group, a occurrences of the phrase, l and r those
    of its parts at the cut with the lowest score (the first such cut).  Phrases of fewer than ``least`` occurrences are no
    candidates; one that a longer candidate holds in half of its occurrences goes.  Ties are ordered by
    occurrences, then by the phrase's bytes.  A null text has no words, a null group is ``und``; equal rows count each; an
    empty table gives no phrase.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "collocations")
    grp = F.coalesce(F.col(group).cast("string"), F.lit("und"))
    plain = docs.select(F.lit(True).alias("row"), F.col(text).cast("string").alias("text"), grp.alias("grp"))
    sequences, listed, _ = store_blocks(plain, ("row",), "text", F.col("grp"), _split_pieces, scratch)
    blocks = listed.select("block").distinct().count()
    splits = 1 + blocks // SPLIT_BLOCKS
    located = word_rows(listed, counts=True).where(F.col("word") != "")
    totals, _ = scratch.store(located.groupBy("grp", "word").agg(F.sum("n").alias("n")))
    sizes = totals.groupBy("grp").agg(F.sum("n").alias("all"))
    words, _ = scratch.store(_ranked(totals.where(F.col("n") >= least), F.col("word")))
    # ids go back to the blocks that have the word
    at_home, _ = scratch.store(located.select("grp", "word", "block", "number").join(
        words.select("grp", "word", "id").hint("merge"), ["grp", "word"])
        .select("block", "number", "id"), compression="zstd")

    def in_blocks(known: DataFrame, run, schema: str) -> DataFrame:
        return sequences.select("block", "grp", "seq").groupBy("block").cogroup(known.groupBy("block")).applyInArrow(run, schema)

    pairs = add_tiles(in_blocks(at_home, _count_pairs(splits), PACKS), blocks, splits, least, scratch)
    pairs, _ = scratch.store(pairs)
    pairs, _ = scratch.store(_ranked(pairs, F.concat(F.lpad(F.hex("a"), 16, "0"), F.lpad(F.hex("b"), 16, "0")).cast("string")))
    triples = in_blocks(at_home, _count_triples(splits, _sketch(pairs)), TRIPLES)
    triples, _ = scratch.store(add_triples(triples, pairs, blocks, splits, least, scratch))
    return _best(words, pairs, triples, sizes, top)


def _best(words: DataFrame, pairs: DataFrame, triples: DataFrame, sizes: DataFrame, top: int) -> DataFrame:
    def word(i: str) -> DataFrame:
        return words.select("grp", F.col("id").alias(i), F.col("word").alias(f"w{i}"), F.col("n").alias(f"n{i}"))

    two = pairs.select("grp", F.col("id").alias("pair"), "a", "b", F.col("n").alias("f"))
    two = two.join(word("a"), ["grp", "a"]).join(word("b"), ["grp", "b"])
    tail = pairs.select("grp", F.col("a").alias("b"), F.col("b").alias("c"), F.col("n").alias("ftail"), F.col("id").alias("tail"))
    three = (triples.join(two.withColumnRenamed("f", "fpair"), ["grp", "pair"]).join(tail, ["grp", "b", "c"])
             .join(word("c"), ["grp", "c"]))
    held = (three.select("grp", F.explode(F.array("pair", "tail")).alias("pair"), "n")
            .groupBy("grp", "pair").agg(F.max("n").alias("longer")))
    two = two.join(held, ["grp", "pair"], "left").where(
        F.col("longer").isNull() | (F.col("longer") * 100 < F.col("f") * ABSORBED))
    two = two.select("grp", F.concat_ws(" ", "wa", "wb").alias("phrase"), F.col("f").alias("a"), F.col("na").alias("l"),
                     F.col("nb").alias("r"), _score("f", "na", "nb").alias("score"))
    early, late = _score("n", "na", "ftail"), _score("n", "fpair", "nc")
    first = early <= late
    three = three.select("grp", F.concat_ws(" ", "wa", "wb", "wc").alias("phrase"), F.col("n").alias("a"),
                         F.when(first, F.col("na")).otherwise(F.col("fpair")).alias("l"),
                         F.when(first, F.col("ftail")).otherwise(F.col("nc")).alias("r"),
                         F.when(first, early).otherwise(late).alias("score"))
    every = two.unionByName(three).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(TOP_SALTS)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the best of each part of a group first, so that no group is ordered whole by one task
    some = every.withColumn("rank", F.row_number().over(Window.partitionBy("grp", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(sizes, "grp").select("grp", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r",
                                            F.col("all").alias("n"), "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per language its first 2000 phrases: lang, rank, phrase, a, l, r, n, score."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang")
    return collocations(docs).withColumnRenamed("grp", "lang")
