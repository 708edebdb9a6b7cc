"""Masked pseudo-likelihood scores of a bidirectional window network (operator 4).

Every word is predicted from the two words before and the two after it, in two
levels that both read the same hidden vector (numpy).  The first level chooses
among the HEAD most frequent words and the classes, the second among the LEAVES of
the class.  Each of the VOCABULARY most frequent words is a unit of its own; all
other words share hashed leaves, and corpus counts share the probability of such a
leaf among its words.  So each word has a proper conditional probability, and
the context decides on every word's unit.  A document's score is the sum of the
logarithms.  The counts of the KNOWN most frequent words go to the tasks; those of all other words
stay in a stored table that grows with the input and are joined to a document's words.

The network starts as the corpus shares and is trained on every word: in each
round, each input split trains a copy on every word of a share of its texts, chosen by a hash of the text, and the
copies are averaged by words seen; the rounds together take every word as a target once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import Scratch, fresh_name
from .textops import as_bytes, word_hashes

VOCABULARY = 8192      # frequent words with an embedding and a unit of their own
HASHED = 1024          # embeddings shared by all other words
KNOWN = 65536          # words whose counts go to the tasks
HEAD = 32              # most frequent words that the first level chooses itself
LEAVES = 128           # units of a class
OWN_CLASSES = -(-(VOCABULARY - HEAD) // LEAVES)
TAIL_CLASSES = 16      # classes of hashed leaves
CLASSES = OWN_CLASSES + TAIL_CLASSES
TAIL = HEAD + OWN_CLASSES * LEAVES  # first hashed unit
UNITS = HEAD + CLASSES * LEAVES
DIM = 16               # the last number of a hidden vector is always 1, so its weights are biases
REACH = 2              # words on either side
ROUNDS = 2             # rounds of training and averaging, each on its share of the texts
BATCH = 4096
RATE = 0.15
START = {"e": 1e-7, "p": 1e-2, "w": 1e-2, "v": 1e-7}  # first sums of squared gradients
LIMIT = 36.0           # logits stay within it, so no probability leaves the normal numbers of 32 bits, where work is slow
BIAS = 4.0             # of it, the part of the bias
SEED = 5
PIECE = 1 << 14        # numbers of a copy's parameters in one shuffled row
FLUSH = 1_500_000
SLOT_BITS = 18
_SLOT_SHIFT = np.uint64(64 - SLOT_BITS)
SCORE_WORDS = 4096
PAD = VOCABULARY + HASHED

_OFFSETS = [o for o in range(-REACH, REACH + 1) if o]
_BOUND = np.array([(LIMIT - BIAS) / (DIM - 1)] * (DIM - 1) + [BIAS], dtype=np.float32)[:, None]
_SHAPES = {"e": (PAD + 1, DIM), "p": (len(_OFFSETS), DIM), "w": (DIM, HEAD + CLASSES), "v": (CLASSES, DIM, LEAVES)}


def _count_words(batches):
    """text -> (word hash, count), summed per task before the shuffle."""
    held: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    size = 0

    def merged():
        words, place = np.unique(np.concatenate(held), return_inverse=True)
        return words, np.bincount(place, weights=np.concatenate(counts)).astype(np.int64)

    for batch in batches:
        for _, _, h in word_hashes(as_bytes(batch.column(0))):
            words, n = np.unique(h, return_counts=True)
            held.append(words)
            counts.append(n)
            size += len(words)
            if size > FLUSH:
                words, n = merged()
                if len(words) > FLUSH // 2:
                    yield pa.record_batch([pa.array(words.view(np.int64)), pa.array(n)], names=["word", "n"])
                    words, n = words[:0], n[:0]
                held, counts, size = [words], [n], len(words)
    if held:
        words, n = merged()
        yield pa.record_batch([pa.array(words.view(np.int64)), pa.array(n)], names=["word", "n"])


class Vocabulary:
    """Ids, units and within-unit log-probabilities of words by their hash; bounded by KNOWN and UNITS.

    A word outside the table of known words is taken as seen once; ``counts`` has its own count.
    """

    def __init__(self, top: list[tuple[int, int]], tail_total: np.ndarray, counts: DataFrame | None = None):
        """top: (hash, count) by count; tail_total: count of all words per hashed unit; counts: stored (word, n) of all words."""
        self.counts = counts
        hashes = np.array([h for h, _ in top], dtype=np.int64).view(np.uint64)
        n = np.array([n for _, n in top], dtype=np.float64)
        self.least = int(n.min()) if len(n) else 0
        own = min(len(top), VOCABULARY)
        unit = np.concatenate([np.arange(own), tail_units(hashes[own:])]).astype(np.int64)
        total = np.maximum(tail_total, 1.0)
        inside = np.zeros(len(top))
        inside[own:] = np.log(n[own:] / total[unit[own:] - TAIL])
        order = np.argsort(hashes)
        self.hashes, self.ids, self.unit, self.inside = hashes[order], order.astype(np.int32), unit[order], inside[order]
        # where the hashes that share their first bits start; few words share a slot
        self.slot = np.searchsorted(self.hashes, np.arange(1 << SLOT_BITS, dtype=np.uint64) << _SLOT_SHIFT).astype(np.int32)
        self.most = int(np.diff(np.append(self.slot, len(hashes))).max())
        self.once = -np.log(total)
        self.share = np.concatenate([n[:own], np.zeros(TAIL - own), tail_total])  # count of every unit

    def __getstate__(self) -> dict:
        return {**self.__dict__, "counts": None}  # tasks do without the table

    def lookup(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(embedding ids, units, log-probability of the word within its unit, whether its count is known) of words."""
        ids = VOCABULARY + (h % np.uint64(HASHED)).astype(np.int64)
        unit = tail_units(h)
        inside, known = self.once[unit - TAIL], np.zeros(len(h), dtype=bool)
        if len(self.hashes):
            near = np.minimum(self.slot[h >> _SLOT_SHIFT], len(self.hashes) - 1)
            known = self.hashes[near] == h
            left = np.flatnonzero(~known)
            for _ in range(1, self.most):
                left = left[near[left] < len(self.hashes) - 1]
                near[left] += 1
                there = self.hashes[near[left]]
                hit = there == h[left]
                known[left[hit]] = True
                left = left[there < h[left]]
            at = near[known]
            unit[known], inside[known] = self.unit[at], self.inside[at]
            ids = np.where(unit < VOCABULARY, unit, ids)
        return ids, unit, inside, known


def tail_units(h: np.ndarray) -> np.ndarray:
    return TAIL + ((h >> np.uint64(20)) % np.uint64(UNITS - TAIL)).astype(np.int64)


def build_vocabulary(docs: DataFrame, text: str, scratch: Scratch) -> Vocabulary:
    """Counts of all words of all documents; what reaches the driver is KNOWN rows and those of the hashed units."""
    counts, _ = scratch.store(docs.select(F.col(text).cast("string")).mapInArrow(_count_words, "word bigint, n bigint")
                              .groupBy("word").agg(F.sum("n").alias("n")))
    known = counts.orderBy(F.desc("n"), "word").limit(KNOWN).toArrow()
    top = list(zip(known["word"].to_pylist(), known["n"].to_pylist()))
    own = docs.sparkSession.createDataFrame([(h,) for h, _ in top[:VOCABULARY]], "word bigint")
    # the unsigned shift and remainder of tail_units, on signed 64-bit words
    unit = F.pmod(F.shiftrightunsigned("word", 20), F.lit(UNITS - TAIL))
    totals = np.zeros(UNITS - TAIL)
    for r in (counts.join(F.broadcast(own), "word", "left_anti").groupBy(unit.alias("unit"))
              .agg(F.sum("n").alias("n")).collect()):
        totals[int(r["unit"])] = r["n"]
    return Vocabulary(top, totals, counts)


def _bias(share: np.ndarray) -> np.ndarray:
    """Logarithms of counts, centred in each row and held within BIAS."""
    logs = np.log(np.maximum(share, 0.5))
    return np.clip(logs - (logs.max(axis=-1, keepdims=True) + logs.min(axis=-1, keepdims=True)) / 2, -BIAS, BIAS)


def initial_parameters(vocabulary: Vocabulary) -> dict[str, np.ndarray]:
    """A network that gives every unit its share of the corpus in any context."""
    rng = np.random.default_rng(SEED)
    out = {k: np.zeros(s, dtype=np.float32) for k, s in _SHAPES.items()}
    out["e"] += rng.normal(0, 0.3, _SHAPES["e"]).astype(np.float32)
    out["p"] += 1.0
    leaves = vocabulary.share[HEAD:].reshape(CLASSES, LEAVES)
    out["w"][-1] = _bias(np.concatenate([vocabulary.share[:HEAD], leaves.sum(axis=1)]))
    out["v"][:, -1] = _bias(leaves)
    return out


def _flat(q: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([q[k].ravel() for k in _SHAPES])


def _shaped(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in _SHAPES.items():
        size = int(np.prod(s))
        out[k] = flat[at:at + size].reshape(s).astype(np.float32)
        at += size
    return out


def _padded(ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids with REACH pads around every text, place of each word in them)."""
    counts = np.diff(offsets)
    place = np.arange(len(ids)) + REACH * (1 + np.repeat(np.arange(len(counts)), counts))
    out = np.full(len(ids) + REACH * (len(counts) + 1), PAD, dtype=np.int64)
    out[place] = ids
    return out, place


class Room:
    """Arrays that one task uses for all its batches; fresh ones of this size cost more than the work on them."""

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        size = int(np.prod(shape))
        if name not in self.held or len(self.held[name]) < size:
            self.held[name] = np.empty(size, dtype=np.float32)
        return self.held[name][:size].reshape(shape)


def _take(rows: np.ndarray, at: np.ndarray, out: np.ndarray) -> np.ndarray:
    return np.take(rows, at, axis=0, out=out, mode="clip")  # no index is outside; other modes copy once more


def _embedded(q, context: np.ndarray, room: Room) -> list[np.ndarray]:
    return [_take(q["e"], context[:, j], room(f"embedded{j}", len(context), DIM)) for j in range(len(_OFFSETS))]


def _hidden(q, embedded: list[np.ndarray], room: Room) -> np.ndarray:
    total = np.multiply(embedded[0], q["p"][0], out=room("hidden", *embedded[0].shape))
    part = room("part", *embedded[0].shape)
    for j in range(1, len(_OFFSETS)):
        total += np.multiply(embedded[j], q["p"][j], out=part)
    np.tanh(total, out=total)
    total[:, -1] = 1
    return total


def _levels(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]], np.ndarray]:
    """(first-level targets, words of classes in order of class, (class, start, end) in that order, their leaves)."""
    first = np.where(unit < HEAD, unit, HEAD + (unit - HEAD) // LEAVES).astype(np.int16)
    order = np.argsort(first, kind="stable")
    order = order[np.searchsorted(first[order], HEAD):]
    ends = np.searchsorted(first[order], np.arange(HEAD, HEAD + CLASSES + 1))
    runs = [(k, a, b) for k, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())) if a < b]
    return first, order, runs, (unit[order] - HEAD) % LEAVES


def _first_logits(q, h: np.ndarray, room: Room) -> np.ndarray:
    return np.matmul(h, q["w"], out=room("first", len(h), HEAD + CLASSES))


def _leaf_logits(q, h: np.ndarray, runs: list[tuple[int, int, int]], room: Room) -> np.ndarray:
    out = room("leaves", len(h), LEAVES)
    for k, a, b in runs:
        np.matmul(h[a:b], q["v"][k], out=out[a:b])
    return out


def _sums(rows: np.ndarray) -> np.ndarray:
    return rows @ np.ones(rows.shape[1], dtype=np.float32)


def _log_softmax_at(logits: np.ndarray, target: np.ndarray) -> np.ndarray:
    picked = logits[np.arange(len(target)), target]
    return picked - np.log(_sums(np.exp(logits, out=logits)))


def unit_logs(q, context: np.ndarray, unit: np.ndarray, room: Room | None = None) -> np.ndarray:
    """Log-probability of each unit in its context."""
    room = room or Room()
    h = _hidden(q, _embedded(q, context, room), room)
    first, order, runs, leaf = _levels(unit)
    out = _log_softmax_at(_first_logits(q, h, room), first)
    below = _take(h, order, room("below", len(order), DIM))
    out[order] += _log_softmax_at(_leaf_logits(q, below, runs, room), leaf)
    return out


def _gradient(logits: np.ndarray, target: np.ndarray, n: int) -> np.ndarray:
    """Gradient of the mean loss over n words by the logits, in their place."""
    np.exp(logits, out=logits)
    logits *= (1 / (_sums(logits) * np.float32(n)))[:, None]
    logits[np.arange(len(target)), target] -= np.float32(1 / n)
    return logits


class Trainer:
    """Adagrad on one copy of the network; embeddings and leaves have one sum of squares per vector."""

    def __init__(self, q: dict[str, np.ndarray]):
        self.q, self.room = {k: v.copy() for k, v in q.items()}, Room()
        shape = {"e": (PAD + 1,), "v": (CLASSES, LEAVES)}
        self.s = {k: np.full(shape.get(k, v.shape), START[k], dtype=np.float32) for k, v in q.items()}

    def gradients(self, context: np.ndarray, unit: np.ndarray):
        """Of the mean loss: (p, w, touched classes, their v, touched embeddings, their e)."""
        q, room, n = self.q, self.room, len(unit)
        embedded = _embedded(q, context, room)
        h = _hidden(q, embedded, room)
        first, order, runs, leaf = _levels(unit)
        d = _gradient(_first_logits(q, h, room), first, n)
        dh = np.matmul(d, q["w"].T, out=room("dh", n, DIM))
        below = _take(h, order, room("below", len(order), DIM))
        d2 = _gradient(_leaf_logits(q, below, runs, room), leaf, n)
        back = room("back", len(order), DIM)
        v = room("v", len(runs), DIM, LEAVES)
        for i, (k, a, b) in enumerate(runs):
            np.matmul(d2[a:b], q["v"][k].T, out=back[a:b])
            np.matmul(below[a:b].T, d2[a:b], out=v[i])
        dh[order] += back
        w = h.T @ d
        dh *= 1 - h * h  # 0 for the last number, which is 1
        values = room("values", len(_OFFSETS), n, DIM)
        for j in range(len(_OFFSETS)):
            np.multiply(dh, q["p"][j], out=values[j])
        rows = context.T.ravel().astype(np.int16)  # PAD fits; 16-bit numbers sort fast
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        start = np.flatnonzero(np.concatenate(([True], rows[1:] > rows[:-1])))
        sorted_values = _take(values.reshape(-1, DIM), order, room("sorted", len(order), DIM))
        return (np.stack([np.einsum("ij,ij->j", x, dh) for x in embedded]), w, [k for k, _, _ in runs], v,
                rows[start], np.add.reduceat(sorted_values, start, axis=0))

    def batch(self, context: np.ndarray, unit: np.ndarray) -> None:
        q, s = self.q, self.s
        p, w, classes, v, touched, e = self.gradients(context, unit)
        for name, grad in (("p", p), ("w", w)):
            s[name] += grad * grad
            q[name] -= RATE * grad / np.sqrt(s[name])
        np.clip(q["w"], -_BOUND, _BOUND, out=q["w"])
        s["v"][classes] += np.einsum("kij,kij->kj", v, v) / DIM
        v *= (RATE / np.sqrt(s["v"][classes]))[:, None, :]
        for i, k in enumerate(classes):
            mine = q["v"][k]
            mine -= v[i]
            np.minimum(np.maximum(mine, -_BOUND, out=mine), _BOUND, out=mine)
        s["e"][touched] += np.einsum("ij,ij->i", e, e) / DIM
        q["e"][touched] -= e * (RATE / np.sqrt(s["e"][touched]))[:, None]


PIECES = "piece int, salt int, numbers binary, seen bigint"


def _piece(i: int, salt: int, numbers: np.ndarray, seen: int) -> pa.RecordBatch:
    """Some parameters of a copy, or their mean over copies, and the words that it saw."""
    return pa.record_batch([pa.array([i], pa.int32()), pa.array([salt], pa.int32()),
                            pa.array([numbers.astype(np.float32).tobytes()], pa.binary()),
                            pa.array([seen], pa.int64())], names=["piece", "salt", "numbers", "seen"])


def _train(held):
    """text -> pieces of the trained copy, weighted by the words it saw."""
    def run(batches):
        vocabulary, q = held.value
        trainer, seen = Trainer(q), 0
        contexts: list[np.ndarray] = []
        targets: list[np.ndarray] = []
        waiting = 0
        for batch in batches:
            for _, offsets, h in word_hashes(as_bytes(batch.column(0))):
                if not len(h):
                    continue
                ids, unit, _, _ = vocabulary.lookup(h)
                padded, place = _padded(ids, offsets)
                contexts.append(np.stack([padded[place + o] for o in _OFFSETS], axis=1))
                targets.append(unit)
                waiting += len(h)
                if waiting >= BATCH:
                    c, t = np.concatenate(contexts), np.concatenate(targets)
                    full = len(t) // BATCH * BATCH
                    for at in range(0, full, BATCH):
                        trainer.batch(c[at:at + BATCH], t[at:at + BATCH])
                    seen += full
                    contexts, targets, waiting = [c[full:]], [t[full:]], len(t) - full
        if waiting:
            trainer.batch(np.concatenate(contexts), np.concatenate(targets))
            seen += waiting
        if seen:
            flat = _flat(trainer.q)
            for i, at in enumerate(range(0, len(flat), PIECE)):
                yield _piece(i, 0, flat[at:at + PIECE], seen)
    return run


def _average(batches):
    """Means of the pieces of one shuffle partition, weighted by words seen, as they stream past."""
    total: dict[tuple[int, int], np.ndarray] = {}
    seen: dict[tuple[int, int], int] = {}
    for batch in batches:
        for i, salt, blob, n in zip(*(c.to_pylist() for c in batch.columns)):
            part = np.frombuffer(blob, dtype=np.float32).astype(np.float64) * n
            key = (i, salt)
            total[key] = total[key] + part if key in total else part
            seen[key] = seen.get(key, 0) + n
    for (i, salt), part in total.items():
        yield _piece(i, salt, part / seen[i, salt], seen[i, salt])


def train(docs: DataFrame, text: str = "text") -> tuple[Vocabulary, dict[str, np.ndarray]]:
    """Vocabulary and network of a corpus; an empty corpus leaves the network as it starts."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "language-model")
    vocabulary = build_vocabulary(docs, text, scratch)
    q = initial_parameters(vocabulary)
    # copies of a piece meet in as many tasks as their number asks for, then the means of these in one
    salts = max(1, round(int(spark.conf.get("spark.sql.shuffle.partitions")) ** 0.5))
    for turn in range(ROUNDS):
        held = spark.sparkContext.broadcast((vocabulary, q))
        part = docs.select(F.col(text).cast("string").alias("t")).where(F.pmod(F.xxhash64("t"), F.lit(ROUNDS)) == turn)
        copies = part.mapInArrow(_train(held), PIECES)
        salted = copies.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        means = salted.repartition("piece", "salt").mapInArrow(_average, PIECES).withColumn("salt", F.lit(0))
        rows = means.repartition("piece").mapInArrow(_average, PIECES).collect()
        if rows:
            q = _shaped(np.concatenate([np.frombuffer(r["numbers"], dtype=np.float32)
                                        for r in sorted(rows, key=lambda r: r["piece"])]))
    return vocabulary, q


def _scored(texts: list[bytes], vocabulary: Vocabulary, q: dict[str, np.ndarray]):
    """(words, summed conditional log-probability, distinct rare words, times of each) of each text."""
    room = Room()
    for _, offsets, h in word_hashes(texts):
        ids, unit, inside, known = vocabulary.lookup(h)
        padded, place = _padded(ids, offsets)
        logp = np.zeros(len(h) + 1)
        for at in range(0, len(h), SCORE_WORDS):
            end = min(len(h), at + SCORE_WORDS)
            context = np.stack([padded[place[at:end] + o] for o in _OFFSETS], axis=1)
            logp[at:end] = unit_logs(q, context, unit[at:end], room) + inside[at:end]
        total = np.concatenate(([0.0], np.cumsum(logp)))
        rare = ~known
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            words, times = np.unique(h[a:b][rare[a:b]], return_counts=True)
            yield b - a, float(total[b] - total[a]), words.view(np.int64), times


def score_texts(texts: list[bytes], vocabulary: Vocabulary, q: dict[str, np.ndarray]) -> list[tuple[int, float]]:
    """(words, summed conditional log-probability) of each text, rare words taken as seen once."""
    return [(n, s) for n, s, _, _ in _scored(texts, vocabulary, q)]


SCORED = "struct<n_words:bigint,log_likelihood:double,words:array<bigint>,times:array<bigint>>"


def score_documents(docs: DataFrame, vocabulary: Vocabulary, q: dict[str, np.ndarray], text: str = "text",
                    keep: tuple[str, ...] | None = None) -> tuple[DataFrame, str]:
    """(table of the ``keep`` columns, all by default, and one more, its name): struct of n_words and log_likelihood.

    A null or empty text has no words and log-likelihood 0.  One row per input
    row; each is scored by its text alone.  A rare word's own count comes from a
    join of the (row, word) pairs with the counts; a word without a count is taken as seen once.
    """
    kept = list(docs.columns if keep is None else keep)
    name = fresh_name(kept, "pseudo_likelihood")
    row = fresh_name([*kept, name], "row")
    held = docs.sparkSession.sparkContext.broadcast((vocabulary, q))

    def run(column: pa.Array) -> pa.Array:
        n, s, words, times = zip(*_scored(as_bytes(column), *held.value)) if len(column) else ((),) * 4
        ends = pa.array(np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64)))
                 for x in (words, times)]
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(s, pa.float64()), *lists],
                                          names=["n_words", "log_likelihood", "words", "times"])

    # stored, so that the network runs once and a row's number is the same on both sides of the join
    scored, _ = Scratch(docs.sparkSession, "pseudo-likelihood").store(docs.select(
        *kept, F.monotonically_increasing_id().alias(row), F.arrow_udf(run, SCORED)(F.col(text).cast("string")).alias(name)))
    pairs = scored.select(row, F.explode(F.arrays_zip(F.col(name)["words"].alias("word"), F.col(name)["times"].alias("times")))
                          .alias("p")).select(row, F.col("p.word").alias("word"), F.col("p.times").alias("times"))
    own = fresh_name([*kept, name, row], "own")
    counts = vocabulary.counts.where(f"n between 2 and {vocabulary.least}")  # log 1 adds nothing, others are known
    logs = pairs.join(counts.hint("merge"), "word").groupBy(row).agg(F.sum(F.col("times") * F.log("n")).alias(own))
    return (scored.join(logs.hint("merge"), row, "left").select(*kept, F.struct(
        F.col(name)["n_words"].alias("n_words"),
        (F.col(name)["log_likelihood"] + F.coalesce(own, F.lit(0.0))).alias("log_likelihood")).alias(name))), name


def op4_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_words, log_likelihood, mean_log_likelihood (null without words)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored, name = score_documents(docs, *train(docs), keep=("doc_id",))
    s = F.col(name)
    return scored.select("doc_id", s["n_words"].alias("n_words"), F.round(s["log_likelihood"], 6).alias("log_likelihood"),
                         F.when(s["n_words"] > 0, F.round(s["log_likelihood"] / s["n_words"], 9)).alias("mean_log_likelihood"))
