"""Toxicity from a learned, weighted lexicon (operator 3).

Texts are folded (case, homoglyphs, digit and symbol substitutions), words are
taken at spaces without outer punctuation, and one Aho-Corasick automaton finds
lexicon entries and exception phrases in one pass.  An entry is a word or the
beginning of a word (stems of inflected forms); a word counts once, by its
heaviest entry, and not at all inside an exception phrase.  The summed weights are normalised by length and
calibrated to a probability.  Lexicon, phrases and calibration are learned from
labelled documents.
"""

from __future__ import annotations

import math
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import Scratch, fresh_name

LABELLED_ROWS = 50_000   # about so many labelled documents are learned from, chosen by hash
LEXICON_SIZE = 2_000
PHRASES = 2_000
MIN_DOCS = 4             # documents of a class that a word or phrase must be in
MIN_WEIGHT = 2.0
MIN_Z = 4.0
COUNTER_ENTRIES = 300_000
BATCH_TEXTS = 256
STEMS = (4, 5, 6)        # lengths of word beginnings that may be entries, written with a final '*'

# Characters that stand for letters.  i, l, 1, ! and | fold to one letter.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "һ": "h",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "ι": "i", "κ": "k", "ν": "v", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ß": "ss",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SYMBOLS = {"@": "a", "$": "s", "!": "i", "|": "i", "€": "e", "£": "l"}
_FOLD = str.maketrans({**HOMOGLYPHS, **DIGITS, **SYMBOLS, "l": "i"}
                      | {chr(0xFF41 + k): chr(97 + k) for k in range(26)})
_OUTER = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "“”„«»‘’…–—¿¡"


def fold_words(text: str) -> list[str]:
    """Folded words of a text; a word keeps one leading substitution symbol, as in '$tupid'."""
    out = []
    for word in text.lower().split():
        core = word.strip(_OUTER) if not (word[0].isalnum() and word[-1].isalnum()) else word
        if not core:
            continue
        if word[0] in SYMBOLS and word[1:len(core) + 1] == core:
            core = word[0] + core
        out.append(core)
    return " ".join(out).translate(_FOLD).split(" ") if out else []  # folding makes no space


def terms_of(words: set[str]) -> set[str]:
    return words | {word[:k] + "*" for k in STEMS for word in words if len(word) > k}


def _count_terms(batches):
    """(toxic, text) -> (term, toxic documents, other documents), counted per task before the shuffle."""
    counts: dict[str, list[int]] = {}

    def out():
        words = list(counts)
        return pa.record_batch([pa.array(words, pa.string()),
                                pa.array([counts[w][0] for w in words], pa.int64()),
                                pa.array([counts[w][1] for w in words], pa.int64())], names=["term", "pos", "neg"])

    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_TEXTS):
            part = batch.slice(at, BATCH_TEXTS)
            for toxic, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                for term in terms_of(set(fold_words(text or ""))):
                    counts.setdefault(term, [0, 0])[0 if toxic else 1] += 1
            if len(counts) > COUNTER_ENTRIES:
                yield out()
                counts.clear()
    yield out()


def _count_phrases(lexicon: set[str]):
    """(toxic, text) -> counts of the two-word phrases around lexicon entries."""
    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = fold_words(text or "")
                seen = set()
                for i, word in enumerate(words):
                    if not lexicon.isdisjoint(terms_of({word})):
                        seen.update(" ".join(words[j:j + 2]) for j in (i - 1, i) if 0 <= j < len(words) - 1)
                counts.update((p, bool(toxic)) for p in seen)
            if len(counts) > COUNTER_ENTRIES:
                yield _phrase_rows(counts)
                counts.clear()
        yield _phrase_rows(counts)
    return run


def _phrase_rows(counts: Counter):
    keys = list(counts)
    return pa.record_batch([pa.array([k[0] for k in keys], pa.string()),
                            pa.array([counts[k] * k[1] for k in keys], pa.int64()),
                            pa.array([counts[k] * (not k[1]) for k in keys], pa.int64())], names=["term", "pos", "neg"])


class Scorer:
    """Lexicon, exception phrases and calibration; small, and sent to every task."""

    def __init__(self, lexicon: dict[str, float], phrases: list[str], coef=(0.0, 0.0, 0.0)):
        self.lexicon, self.phrases, self.coef = lexicon, phrases, coef
        self._machine = None

    def __getstate__(self):
        return self.lexicon, self.phrases, self.coef

    def __setstate__(self, state):
        self.lexicon, self.phrases, self.coef = state
        self._machine = None

    def machine(self):
        if self._machine is None:
            self._machine = ahocorasick.Automaton()
            for term, weight in self.lexicon.items():
                key = f" {term[:-1]}" if term.endswith("*") else f" {term} "
                self._machine.add_word(key, (len(key), weight))
            for phrase in self.phrases:
                self._machine.add_word(f" {phrase} ", (len(phrase) + 2, None))
            self._machine.make_automaton()
        return self._machine

    def features(self, text: str) -> tuple[float, float, list[str]]:
        """(weight per word, log of total weight, matched words)."""
        words = fold_words(text)
        machine = self.machine()
        if not words or not len(machine):
            return 0.0, 0.0, []
        folded = " " + " ".join(words) + " "
        heaviest: dict[int, float] = {}  # by the place of the space before a word
        excused: list[tuple[int, int]] = []
        for end, (size, weight) in machine.iter(folded):
            at = end - size + 1
            if weight is None:
                excused.append((at, end))
            else:
                heaviest[at] = max(weight, heaviest.get(at, 0.0))
        covered = {at for a, b in excused for at in range(a, b) if at in heaviest}
        hits = {at: w for at, w in heaviest.items() if at not in covered}
        total = sum(hits.values())
        return (100 * total / (len(words) + 20), math.log1p(total),
                [folded[at + 1:folded.index(" ", at + 1)] for at in sorted(hits)])

    def score(self, x: float, y: float) -> float:
        z = self.coef[0] + self.coef[1] * math.log1p(x) + self.coef[2] * y
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Ridge logistic regression by Newton steps."""
    a = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(a.shape[1])
    ridge = np.diag([1e-6] + [1e-2] * x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p) + 1e-9)[:, None]) + ridge, a.T @ (y - p) - ridge @ b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in b)


def _own_evidence(chosen: list, pos: int, neg: int) -> list:
    """Lexicon rows without the word beginnings that owe their weight to one whole word.

    A beginning stays when it speaks for label 1 in the documents beyond
    those of its most frequent whole word as well, or when there is nothing
    beyond them.
    """
    words: dict[str, tuple[int, int]] = {}
    for r in chosen:
        if not r["term"].endswith("*"):
            for k in STEMS:
                if len(r["term"]) > k:
                    words[r["term"][:k]] = max(words.get(r["term"][:k], (0, 0)), (r["pos"], r["neg"]))
    kept = []
    for r in chosen:
        p, n = words.get(r["term"][:-1], (0, 0)) if r["term"].endswith("*") else (0, 0)
        p, n = max(0, r["pos"] - p), max(0, r["neg"] - n)
        if (p, n) == (0, 0) or (p + 0.5) * (neg + 1) > (n + 0.5) * (pos + 1):
            kept.append(r)
    return kept


def learn(labelled: DataFrame, label: str = "toxic", text: str = "text", rows: int = LABELLED_ROWS) -> Scorer:
    """Learn a scorer from (label, text) rows; null labels do not count, null texts are empty.

    About ``rows`` labelled documents are used, chosen by a hash of the text.  Without
    both classes the scorer has no lexicon and returns the share of label 1 (0.5 when nothing is labelled).
    """
    scratch = Scratch(labelled.sparkSession, "toxicity")
    known = labelled.where(F.col(label).isNotNull()).select(
        (F.col(label).cast("double") > 0).alias("toxic"), F.col(text).cast("string").alias("text"))
    share = min(1.0, rows / max(1, known.count()))
    kept, path = scratch.store(known.where(
        F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(1 << 20)) < int(share * (1 << 20))))
    sizes = kept.agg(F.sum(F.col("toxic").cast("int")), F.count(F.lit(1))).first()
    pos, neg = sizes[0] or 0, (sizes[1] or 0) - (sizes[0] or 0)
    if not pos or not neg:
        scratch.drop(path)
        return Scorer({}, [], (0.0 if not pos + neg else 5.0 if pos else -5.0, 0.0, 0.0))

    def weighed(terms: DataFrame) -> DataFrame:
        p, n = F.col("pos") + 0.5, F.col("neg") + 0.5
        odds = F.log(p / (F.lit(pos + 1.0) - p)) - F.log(n / (F.lit(neg + 1.0) - n))
        return (terms.groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
                .withColumn("weight", odds).withColumn("z", odds / F.sqrt(F.lit(1.0) / p + F.lit(1.0) / n)))

    counted = kept.mapInArrow(_count_terms, "term string, pos bigint, neg bigint")
    chosen = (weighed(counted).where((F.col("pos") >= MIN_DOCS) & (F.col("weight") >= MIN_WEIGHT) & (F.col("z") >= MIN_Z))
              .orderBy(F.desc("z"), "term").limit(LEXICON_SIZE).collect())
    lexicon = {r["term"]: r["weight"] for r in _own_evidence(chosen, pos, neg)}
    near = kept.mapInArrow(_count_phrases(set(lexicon)), "term string, pos bigint, neg bigint")
    excused = (weighed(near).where((F.col("neg") >= MIN_DOCS) & (F.col("weight") <= 0))
               .orderBy("z", "term").limit(PHRASES).collect()) if lexicon else []
    scorer = Scorer(lexicon, [r["term"] for r in excused])

    def measure(batches):
        for batch in batches:
            f = [scorer.features(t or "") for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array([math.log1p(v[0]) for v in f], pa.float64()),
                                   pa.array([v[1] for v in f], pa.float64())], names=["toxic", "x", "y"])

    sample = kept.mapInArrow(measure, "toxic boolean, x double, y double").toPandas()  # about ``rows`` pairs of numbers
    order = np.lexsort((sample["y"], sample["x"], sample["toxic"]))
    scorer.coef = _logistic(sample[["x", "y"]].to_numpy(float)[order], sample["toxic"].to_numpy(float)[order])
    scratch.drop(path)
    return scorer


RESULT = "struct<score:double,words:array<string>>"


def score_toxicity(docs: DataFrame, scorer: Scorer, text: str = "text") -> tuple[DataFrame, str]:
    """(docs with one more column, its name): struct of score (0 to 1) and matched folded words.

    Null and empty texts score as texts without matches.  Every input column
    stays, every row is scored by its text alone.
    """
    name = fresh_name(docs.columns, "toxicity")

    def run(column: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(column), BATCH_TEXTS):
            for t in column.slice(at, BATCH_TEXTS).to_pylist():
                x, y, words = scorer.features(t or "")
                out.append({"score": scorer.score(x, y), "words": words})
        return pa.array(out, pa.struct([("score", pa.float64()), ("words", pa.list_(pa.string()))]))

    return docs.withColumn(name, F.arrow_udf(run, RESULT)(F.col(text).cast("string"))), name


def some_labels(labels: DataFrame, label: str = "toxic", key: str = "doc_id", rows: int = LABELLED_ROWS) -> DataFrame:
    """(key, label): the highest non-null label of about ``rows`` keys, chosen by a hash of the key.

    Null keys do not count.  The result is bounded by ``rows``, so it can be sent to every task.
    """
    known = (labels.where(F.col(label).isNotNull() & F.col(key).isNotNull())
             .groupBy(key).agg(F.max(label).alias(label)))
    share = min(1.0, rows / max(1, known.count()))
    return known.where(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < int(share * (1 << 20)))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    labels = some_labels(spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held))
    scorer = learn(docs.join(F.broadcast(labels), "doc_id"))  # texts stay where they are read
    marked, name = score_toxicity(docs, scorer)
    score = F.col(name)["score"]
    return marked.select("doc_id", held.alias("held_out"), score.alias("score"),
                         F.when(score >= 0.5, 1).otherwise(0).alias("predicted"))
