"""Near-duplicate groups by an exact n-gram Jaccard join (operator 7).

Rare-first prefix filtering.  A document is the set of its distinct word
n-grams.  All sets share one order of n-grams: those from rarer frequency
buckets first, ties by hash.  Two sets with Jaccard similarity of at least t
have a common n-gram among the first ``n - ceil(t n) + 1`` of each, so only
these prefixes are shuffled and met by n-gram.  Pairs that meet pass a length
filter, a positional filter and a suffix filter, and the ones that survive
are compared once, on whole sets.

Nothing lists all pairs of a group.  Every n-gram's members are first compared
with one of them only (the one whose own n-grams are most frequent, which among
copies of one text is the text nearest to all others); further rounds compare
members that are still in other components with another representative, and
what then remains of an n-gram's members across different components is joined
directly.  Members of one component need no comparison.  A pair that is similar
always passes the filters at its first common n-gram, so the result is the exact
set of components whatever the group sizes.

Exact copies (equal sets) are one class from the start.  Joins between tables
that grow with the input are merge joins at every size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .components import connected_components
from .storage import Scratch, fresh_name
from .textops import as_bytes, mix, whole_hash, window_hashes, word_hashes

WORDS = 5
SIMILARITY_PERCENT = 75
SKETCH_BITS = 20          # frequency buckets: 2^20 counters, 4 MB, whatever the input
SLICE = 1 << 16           # counters in one shuffled piece of a task's sketch
HOT = 20_000              # n-grams from buckets above this count are spread over salts
SALTS = 16
SUFFIX_BINS = 16
FILTER_BITS = 20          # bits of the filter that thins the texts before they are joined with wanted classes
OUT_ROWS = 1 << 15
BATCH_TEXTS = 256


def _sets(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; one whole-sequence item when it has fewer words."""
    for _, offsets, words in word_hashes(texts):
        grams_at, grams = window_hashes(words, offsets, size)
        for i in range(len(offsets) - 1):
            n_words = offsets[i + 1] - offsets[i]
            if n_words >= size:
                g = np.sort(grams[grams_at[i]:grams_at[i + 1]])
                yield g[np.concatenate(([True], g[1:] != g[:-1]))]
            elif n_words:
                yield np.array([whole_hash(words[offsets[i]:offsets[i + 1]])], dtype=np.uint64)
            else:
                yield np.zeros(0, dtype=np.uint64)


def _class_of(grams: np.ndarray) -> int | None:
    """64-bit id of a set; None for the empty set."""
    if not len(grams):
        return None
    total = np.add.reduce(mix(grams ^ np.uint64(0xA5A5A5A5A5A5A5A5))) + np.uint64(len(grams))
    return int(mix(np.array([total], dtype=np.uint64)).view(np.int64)[0])


def _buckets(grams: np.ndarray) -> np.ndarray:
    return (grams & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)


def _suffix_counts(grams: np.ndarray) -> np.ndarray:
    return np.bincount((grams >> np.uint64(60)).astype(np.int64), minlength=SUFFIX_BINS)


def _pieces(batches, text_at: int):
    """Record batches in pieces of few texts, so that a task holds little at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_TEXTS):
            piece = batch.slice(at, BATCH_TEXTS)
            yield piece, as_bytes(piece.column(text_at))


def _classify(size: int, key_type: pa.DataType):
    """Row -> (key, class, set size, suffix counts), then the task's frequency sketch in slices."""
    schema = pa.schema([("key", key_type), ("cls", pa.int64()), ("n", pa.int32()), ("bins", pa.list_(pa.int32())),
                        ("piece", pa.int32()), ("counts", pa.binary())])

    def run(batches):
        sketch = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        for piece, texts in _pieces(batches, 1):
            cls, n, bins, seen = [], [], [], []
            for grams in _sets(texts, size):
                cls.append(_class_of(grams))
                n.append(len(grams))
                bins.append(_suffix_counts(grams).tolist())
                seen.append(grams)
            sketch += np.bincount(_buckets(np.concatenate(seen)), minlength=len(sketch)) if seen else 0
            rows = len(cls)
            yield pa.record_batch([piece.column(0), pa.array(cls, pa.int64()), pa.array(n, pa.int32()),
                                   pa.array(bins, pa.list_(pa.int32())), pa.nulls(rows, pa.int32()),
                                   pa.nulls(rows, pa.binary())], schema=schema)
        for p in range(len(sketch) // SLICE):
            part = sketch[p * SLICE:(p + 1) * SLICE]
            if part.any():
                yield pa.record_batch([pa.nulls(1, key_type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()),
                                       pa.nulls(1, pa.list_(pa.int32())), pa.array([p], pa.int32()),
                                       pa.array([part.tobytes()], pa.binary())], schema=schema)
    return run


def _sum_slices(batches):
    """Sum the slices of one shuffle partition as they stream past."""
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for p, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            part = np.frombuffer(blob, dtype=np.int64)
            totals[p] = totals[p] + part if p in totals else part
    for p, part in totals.items():
        yield pa.record_batch([pa.array([p], pa.int32()), pa.array([part.tobytes()], pa.binary())],
                              names=["piece", "counts"])


def _frequency(slices: DataFrame) -> np.ndarray:
    """The corpus-wide bucket counts (2^20 numbers, a bound that no input changes)."""
    summed = (slices.repartition(SALTS, "piece").mapInArrow(_sum_slices, "piece int, counts binary").collect())
    total = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
    for row in summed:
        total[row["piece"] * SLICE:(row["piece"] + 1) * SLICE] = np.frombuffer(row["counts"], dtype=np.int64)
    return total


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def _prefixes(size: int, percent: int, frequency):
    """Row -> one row per prefix n-gram of each class that the task meets for the first time."""
    names = ["gram", "salt", "core", "cls", "n", "pos"]

    def run(batches):
        freq = frequency.value
        met: set[int] = set()
        held: list[list[np.ndarray]] = []
        rows = 0

        def out():
            cols = [np.concatenate(x) for x in zip(*held)]
            return pa.record_batch([pa.array(c) for c in cols], names=names)

        for _, texts in _pieces(batches, 0):
            for grams in _sets(texts, size):
                cls = _class_of(grams)
                if cls is None or cls in met:
                    continue
                met.add(cls)
                count = freq[_buckets(grams)]
                k = prefix_length(len(grams), percent)
                order = np.lexsort((grams, count))[:k]
                hot = count[order] > HOT
                held.append([grams[order].view(np.int64),
                             np.where(hot, 1 + (cls % SALTS), 0).astype(np.int32),
                             np.full(k, -int(count.mean()), dtype=np.int64),
                             np.full(k, cls, dtype=np.int64), np.full(k, len(grams), dtype=np.int32),
                             np.arange(k, dtype=np.int32)])
                rows += k
                if rows >= OUT_ROWS:
                    yield out()
                    held, rows = [], 0
        if held:
            yield out()
    return run


# Rows that leave the meeting of one n-gram's members.
PAIR, MEMBER, HEAD = 0, 1, 2
MET = "kind int, gram bigint, a bigint, b bigint, na int, nb int, pa int, pb int"


def _may_match(na, nb, pa_, pb, percent):
    """Length and positional filter of rows that meet at positions pa_, pb of sets of na, nb n-grams."""
    na, nb = na.astype(np.int64), nb.astype(np.int64)
    rest = np.minimum(na - pa_, nb - pb)
    return ((np.minimum(na, nb) * 100 >= np.maximum(na, nb) * percent)
            & (rest * (100 + percent) >= percent * (na + nb)))


def _meet(percent: int):
    """Sorted member rows -> pairs with each n-gram's first member, members of larger groups, heads of salted groups.

    Input is sorted by (gram, salt, core, cls) and streams past; only the first
    two members of the current n-gram are held.
    """
    names = [c.split()[0] for c in MET.split(", ")]

    def emit(kind, gram, a, b, na, nb, p, q):
        size = len(gram)
        cols = [np.full(size, kind, dtype=np.int32), gram, a, b, na, nb, p, q]
        return pa.record_batch([pa.array(c) for c in cols], names=names)

    def run(batches):
        # the open group: its key, first two members (cls, n, pos), number of distinct members, last class
        key, first, count, last_cls = None, [], 0, None
        for batch in batches:
            gram, salt, cls, n, pos = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3, 4, 5))
            if not len(gram):
                continue
            new_key = np.concatenate(([True], (gram[1:] != gram[:-1]) | (salt[1:] != salt[:-1])))
            new_row = new_key | np.concatenate(([True], cls[1:] != cls[:-1]))
            goes_on = key == (gram[0], salt[0])
            if goes_on:
                new_key[0] = False
                new_row[0] = cls[0] != last_cls
            last_cls = cls[-1]
            at = np.flatnonzero(new_row)
            if not len(at):
                continue
            gram, salt, cls, n, pos, new_key = gram[at], salt[at], cls[at], n[at], pos[at], new_key[at]
            # put the held members of the open group in front, so that every group starts at its head
            held = len(first) if goes_on and not new_key[0] else 0
            before = count if held else 0
            if held:
                put = lambda i, x: np.concatenate((np.array([f[i] for f in first], dtype=x.dtype), x))
                cls, n, pos = put(0, cls), put(1, n), put(2, pos)
                gram = np.concatenate((np.full(held, gram[0]), gram))
                salt = np.concatenate((np.full(held, salt[0]), salt))
                new_key = np.concatenate(([True] + [False] * (held - 1), new_key))
            start = np.flatnonzero(new_key)
            group = np.cumsum(new_key) - 1
            head = start[group]
            rank = np.arange(len(gram)) - head
            sizes = np.bincount(group)
            fresh = np.arange(len(gram)) >= held
            pair = (rank > 0) & fresh & _may_match(n[head], n, pos[head], pos, percent)
            if pair.any():
                h = head[pair]
                yield emit(PAIR, gram[pair], cls[h], cls[pair], n[h], n[pair], pos[h], pos[pair])
            whole = sizes + np.where(np.arange(len(sizes)) == 0, max(0, before - held), 0)
            member = (salt > 0) | (whole[group] >= 3)
            # members that an earlier batch has already sent
            member &= fresh | ((salt == 0) & (before <= 2))
            if member.any():
                yield emit(MEMBER, gram[member], cls[member], cls[member], n[member], n[member],
                           pos[member], pos[member])
            heads = (rank == 0) & (salt > 0) & fresh
            if heads.any():
                yield emit(HEAD, gram[heads], cls[heads], cls[heads], n[heads], n[heads], pos[heads], pos[heads])
            last = start[-1]
            count = int(sizes[-1]) + (max(0, before - held) if len(start) == 1 else 0)
            key = (gram[-1], salt[-1])
            first = [(cls[i], n[i], pos[i]) for i in range(last, min(len(gram), last + 2))]
    return run


def _needed(na, nb, percent: int):
    """Least number of shared n-grams of two sets of these sizes that are similar enough."""
    return F.ceil((F.lit(percent) * (na + nb)) / F.lit(100 + percent))


def _distinct_pairs(pairs: DataFrame) -> DataFrame:
    """One row per pair, smaller class first."""
    return (pairs.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"),
                         F.when(F.col("a") < F.col("b"), F.col("na")).otherwise(F.col("nb")).alias("nx"),
                         F.when(F.col("a") < F.col("b"), F.col("nb")).otherwise(F.col("na")).alias("ny"))
            .distinct().toDF("a", "b", "na", "nb"))


def _suffix_filter(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Fixed pivots cut both sets into 16 ranges of hashes; each range shares at most its smaller part."""
    left = classes.select(F.col("cls").alias("a"), F.col("bins").alias("ba"))
    right = classes.select(F.col("cls").alias("b"), F.col("bins").alias("bb"))
    most = F.aggregate(F.zip_with("ba", "bb", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    return (pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b")
            .where(most >= _needed(F.col("na"), F.col("nb"), percent)).select("a", "b"))


def _similar(size: int, percent: int):
    """(class, class, text, text) -> whether the sets of the texts are similar; each distinct text of a piece is cut once."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_TEXTS):
                piece = batch.slice(at, BATCH_TEXTS)
                a, b = piece.column(0).to_pylist(), piece.column(1).to_pylist()
                left, right = as_bytes(piece.column(2)), as_bytes(piece.column(3))
                texts = list({*left, *right})
                sets = dict(zip(texts, _sets(texts, size)))
                classes = {t: _class_of(g) for t, g in sets.items()}
                rows = []
                for p, q, s, t in zip(a, b, left, right):
                    if classes[s] == p and classes[t] == q:
                        x, y = sets[s], sets[t]
                        shared = len(np.intersect1d(x, y, assume_unique=True))
                        rows.append((p, q, 100 * shared >= percent * (len(x) + len(y) - shared)))
                cols = list(zip(*rows)) if rows else [(), (), ()]
                yield pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                                       pa.array(cols[2], pa.bool_())], names=["a", "b", "similar"])
    return run


class _Join:
    """One run of the join; holds the stored tables that its rounds share."""

    def __init__(self, docs: DataFrame, key: str, text: str, size: int, percent: int):
        self.spark: SparkSession = docs.sparkSession
        self.size, self.percent = size, percent
        self.docs = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
        self.key_type = self.docs.schema["key"].dataType
        self.scratch = Scratch(self.spark, "ngram-join")
        self.tested: DataFrame | None = None
        self.links: DataFrame | None = None
        self.link_paths: list[str] = []

    def classify(self) -> None:
        schema = (f"key {self.key_type.simpleString()}, cls bigint, n int, bins array<int>, piece int, counts binary")
        table, _ = self.scratch.store(self.docs.mapInArrow(_classify(self.size, to_arrow_type(self.key_type)), schema))
        self.rows = table.where("piece is null").select("key", "cls", "n")
        self.classes = (table.where("cls is not null").groupBy("cls")
                        .agg(F.min("key").alias("key"), F.first("bins").alias("bins")))
        self.frequency = self.spark.sparkContext.broadcast(
            _frequency(table.where("piece is not null").select("piece", "counts")))

    def meet(self) -> None:
        prefixes = self.docs.select("text").mapInArrow(
            _prefixes(self.size, self.percent, self.frequency),
            "gram bigint, salt int, core bigint, cls bigint, n int, pos int")
        met = (prefixes.repartition("gram", "salt").sortWithinPartitions("gram", "salt", "core", "cls")
               .mapInArrow(_meet(self.percent), MET))
        self.met, self.met_path = self.scratch.store(met)

    def members(self) -> DataFrame:
        return (self.met.where(F.col("kind") == MEMBER)
                .select("gram", F.col("a").alias("cls"), F.col("na").alias("n"), F.col("pa").alias("pos")))

    def head_pairs(self) -> DataFrame:
        """Pairs with an n-gram's first member; the heads of a salted n-gram's parts meet the smallest of them."""
        heads = self.met.where(F.col("kind") == HEAD)
        low = heads.groupBy("gram").agg(F.min(F.struct("a", "na", "pa")).alias("f"))
        across = (heads.select("gram", F.col("b"), "nb", "pb").join(low, "gram")
                  .select(F.col("f.a").alias("a"), "b", F.col("f.na").alias("na"), "nb", F.col("f.pa").alias("pa"), "pb")
                  .where(F.col("a") != F.col("b")).where(self.may_match()))
        return self.met.where(F.col("kind") == PAIR).select("a", "b", "na", "nb", "pa", "pb").union(across)

    def may_match(self):
        """Length filter; positional filter: two sets whose first common n-gram is at pa and pb share no more
        than what is left of each from there.  A similar pair passes where its first common n-gram is met."""
        total = (F.col("na") + F.col("nb")).cast("bigint")
        rest = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")).cast("bigint")
        return ((F.least("na", "nb").cast("bigint") * 100 >= F.greatest("na", "nb").cast("bigint") * self.percent)
                & (rest * (100 + self.percent) >= total * self.percent))

    def texts_of(self, wanted: DataFrame) -> DataFrame:
        """(cls, text) of wanted (cls, slot) rows, slot being a hash of the key.  A bitmap of slots, of one size
        for any input, thins the texts before the join; what it lets through wrongly, the join drops.  Another
        text under the same key or slot may come along; ``_similar`` drops it by its class."""
        at = F.pmod(F.col("slot"), F.lit(1 << FILTER_BITS))
        # Spark numbers the bits of its bitmaps from 1
        bits = (wanted.select((at + 1).alias("s")).groupBy(F.bitmap_bucket_number("s").alias("i"))
                .agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("m")).collect())
        bitmap = bytearray((1 << FILTER_BITS) // 8)
        for row in bits:
            bitmap[(row["i"] - 1) * 4096:row["i"] * 4096] = row["m"]
        byte = F.conv(F.hex(F.substring(F.lit(bitmap), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10)
        near = (self.docs.select(F.xxhash64("key").alias("slot"), "text")
                .where(F.getbit(byte.cast("bigint"), (at % 8).cast("int")) == 1))
        return near.join(wanted.hint("merge"), "slot").select("slot", "cls", "text").distinct().select("cls", "text")

    def verify(self, pairs: DataFrame) -> bool:
        """Compare new pairs on whole sets; True if there is a new link."""
        pairs = _suffix_filter(_distinct_pairs(pairs), self.classes, self.percent)
        if self.tested is not None:
            pairs = pairs.join(self.tested.hint("merge"), ["a", "b"], "left_anti")
        pairs, pairs_path = self.scratch.store(pairs)
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
        slots = self.classes.select("cls", F.xxhash64("key").alias("slot"))
        wanted, wanted_path = self.scratch.store(wanted.join(slots.hint("merge"), "cls"))
        texts, texts_path = self.scratch.store(self.texts_of(wanted))
        left = texts.select(F.col("cls").alias("a"), F.col("text").alias("ta"))
        right = texts.select(F.col("cls").alias("b"), F.col("text").alias("tb"))
        checked, path = self.scratch.store(
            pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "ta", "tb")
            .mapInArrow(_similar(self.size, self.percent), "a bigint, b bigint, similar boolean"))
        self.scratch.drop(pairs_path, wanted_path, texts_path)
        new = checked.where("similar").select("a", "b")
        self.tested = checked.select("a", "b") if self.tested is None else self.tested.union(checked.select("a", "b"))
        self.links = new if self.links is None else self.links.union(new)
        return not new.isEmpty()

    def relabel(self) -> None:
        self.component, _ = connected_components(self.links, self.scratch)

    def labelled(self) -> DataFrame:
        return (self.members().join(self.component.withColumnRenamed("node", "cls").hint("merge"), "cls", "left")
                .select("gram", "cls", "n", "pos", F.coalesce("component", "cls").alias("comp")))

    def open_members(self) -> tuple[DataFrame, str, int, int]:
        """Members of n-grams whose members are in different components, and how many pairs these leave.

        A member stays only if some partner could pass the filters: the smallest set it may match leaves it
        enough after its position, and some member has enough left for a set of its size.
        """
        lab = self.labelled()
        per = 100 + self.percent
        left = (F.col("n") - F.col("pos")).cast("bigint") * per - F.col("n").cast("bigint") * self.percent
        spread = (lab.groupBy("gram").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("n").alias("least"),
                                          F.max(left).alias("most")).where("lo != hi").drop("lo", "hi"))
        partner = F.greatest(F.ceil(F.col("n") * self.percent / 100), F.col("least")) * self.percent
        rest, path = self.scratch.store(
            lab.join(spread.hint("merge"), "gram").where((left >= partner) & (F.col("most") >= F.col("n") * self.percent))
            .select("gram", "cls", "n", "pos", "comp"))
        by_comp = rest.groupBy("gram", "comp").agg(F.count(F.lit(1)).cast("double").alias("c"))
        per_gram = by_comp.groupBy("gram").agg(((F.pow(F.sum("c"), 2) - F.sum(F.col("c") * F.col("c"))) / 2).alias("p"),
                                               F.sum("c").alias("c"))
        row = per_gram.agg(F.sum("p"), F.sum("c")).first()
        return rest, path, float(row[0] or 0), float(row[1] or 0)

    def other_pairs(self, rest: DataFrame, turn: int) -> DataFrame:
        """Members against one representative of their n-gram from another component."""
        rep = rest.groupBy("gram").agg(F.min(F.struct(F.xxhash64("cls", F.lit(turn)).alias("h"), "cls", "n", "pos",
                                                      "comp")).alias("r"))
        return (rest.join(rep.hint("merge"), "gram").where(F.col("comp") != F.col("r.comp"))
                .select(F.col("r.cls").alias("a"), F.col("cls").alias("b"), F.col("r.n").alias("na"),
                        F.col("n").alias("nb"), F.col("r.pos").alias("pa"), F.col("pos").alias("pb"))
                .where(self.may_match()))

    def all_pairs(self, rest: DataFrame) -> DataFrame:
        """What is left: members of one n-gram in different components, each pair through the filters."""
        side = lambda s: rest.select("gram", *[F.col(c).alias(s + c) for c in ("cls", "n", "pos", "comp")])
        return (side("x").join(side("y").hint("merge"), "gram").where("xcls < ycls and xcomp != ycomp")
                .select(F.col("xcls").alias("a"), F.col("ycls").alias("b"), F.col("xn").alias("na"),
                        F.col("yn").alias("nb"), F.col("xpos").alias("pa"), F.col("ypos").alias("pb"))
                .where(self.may_match()))

    def run(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        self.classify()
        self.meet()
        self.verify(self.head_pairs())
        self.relabel()
        turn, before = 0, math.inf
        while True:
            rest, path, left, rows = self.open_members()
            if not left:
                break
            # another round of representatives while these settle more than they cost
            if left > 4 * rows and left < 0.9 * before:
                if self.verify(self.other_pairs(rest, turn)):
                    self.relabel()
                turn, before = turn + 1, left
                self.scratch.drop(path)
                continue
            if self.verify(self.all_pairs(rest)):
                self.relabel()
            self.scratch.drop(path)
            break
        return self.rows, self.links, self.component


def ngram_components(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = WORDS,
                     percent: int = SIMILARITY_PERCENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, links, components) of the join.

    rows: (key, cls, n), one per input row: class of equal sets and set size.
    links: (a, b), similar pairs of different classes that were compared.
    components: (node, component) for every class with a link.

    A null or empty text, or one without words, is the empty set: class null,
    linked with nothing.  Fewer than ``size`` words are one item, the whole
    sequence.  Rows with equal keys are separate rows.  Keys may be null.
    An empty table gives three empty tables.
    """
    return _Join(docs, key, text, size, percent).run()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = WORDS,
                    percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """(key, n, group, component) per row: ``group`` is the component's class (null for the empty set),
    ``component`` the smallest non-null key in the component, the row's own key for the empty set."""
    rows, _, comp = ngram_components(docs, key, text, size, percent)
    lab = (rows.join(comp.withColumnRenamed("node", "cls").hint("merge"), "cls", "left")
           .select("key", "n", F.coalesce("component", "cls").alias("group")))
    least = lab.where("group is not null").groupBy("group").agg(F.min("key").alias("least"))
    return (lab.join(least.hint("merge"), "group", "left")
            .select("key", "n", "group", F.when(F.col("group").isNull(), F.col("key"))
                    .otherwise(F.col("least")).alias("component")))


def keep_one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = WORDS,
                     percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """The rows of ``docs``, unchanged: one of each component, the one with the smallest key (nulls last; of
    equal keys one by hash).  Rows without words are linked with nothing and stay.
    """
    whole = F.struct(*[F.col(c) for c in docs.columns])
    mark = fresh_name(docs.columns, "mark")
    marked = docs.withColumn(mark, F.struct(F.col(key).isNull().alias("missing"), F.col(key).alias("key"),
                                            F.xxhash64(whole).alias("h1"), F.xxhash64(whole, F.lit(1)).alias("h2")))
    rows, _, comp = ngram_components(marked, mark, text, size, percent)
    lab = (rows.where("cls is not null").join(comp.withColumnRenamed("node", "cls"), "cls", "left")
           .groupBy(F.coalesce("component", "cls").alias("group")).agg(F.min("key").alias(mark)).select(mark))
    empty = rows.where("cls is null").select(F.col("key").alias(mark))
    # equal rows have equal marks: one of them stays, while rows without words all stay
    number = fresh_name(docs.columns + [mark], "number")
    kept = marked.join(lab.union(empty.distinct()), mark, "left_semi")
    order = Window.partitionBy(mark).orderBy(F.lit(1))
    wordless = ~F.coalesce(F.col(text).cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return (kept.withColumn(number, F.row_number().over(order)).where((F.col(number) == 1) | wordless)
            .drop(mark, number))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select(F.col("key").alias("doc_id"), F.col("n").cast("bigint").alias("n_shingles"),
                                        F.col("component").alias("component_id"))
