"""Language identification as a mixture of languages (operator 9).

Each language has likelihoods of byte trigrams within words.  A document is a
mixture: every word comes from one of the document's languages.
Expectation-maximisation estimates the proportions, and the language set is
the one with the best penalised likelihood (BIC) among the sets of the
most frequent languages.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import fresh_name
from .textops import GROUP_BYTES

TRAIN_ROWS = 3_000    # about so many labelled documents of each language are learned from, chosen by hash
BUCKETS = 1 << 16
SMOOTHING = 0.5
ROUNDS = 12
PENALTY = 1.0         # multiple of the BIC penalty for each further language
MIN_SHARE = 0.5       # documents without a language that holds this share are rejected by ``keep_known``
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
_FOLD = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def fold(text: str) -> bytes:
    """Lower-case UTF-8 with a space for every ASCII character that is no letter."""
    return text.lower().encode("utf-8", "replace").translate(_FOLD)


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def _trigrams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, buckets) of the trigram around every byte of a word; word ends are spaces."""
    places = np.flatnonzero(data != 32)
    x = data.astype(np.uint32)
    code = (x[places - 1] << 16) | (x[places] << 8) | x[places + 1]
    return places, ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64) % BUCKETS


def _count_trigrams(batches):
    """(lang, text) -> (lang, bucket, count), summed per task."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            data = np.frombuffer(b" " + fold(text or "") + b" ", dtype=np.uint8)
            total = counts.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
            total += np.bincount(_trigrams(data)[1], minlength=BUCKETS)
    for lang, total in counts.items():
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()),
                               pa.array(total[at], pa.int64())], names=["lang", "bucket", "n"])


class Model:
    """Languages and log-likelihoods of trigram buckets, (BUCKETS, languages)."""

    def __init__(self, langs: list[str], logp: np.ndarray):
        self.langs, self.logp = langs, logp


def learn(labelled: DataFrame, lang: str = "lang", text: str = "text", rows: int = TRAIN_ROWS) -> Model:
    """Learn from (lang, text) rows; null languages and null texts are left out.

    About ``rows`` documents of each language are used, chosen by a hash of the
    text.  What reaches the driver is at most BUCKETS numbers per language.
    """
    known = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), dtype=np.float32))
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, int(min(1.0, rows / sizes[k]) * (1 << 20)))])
    sample = known.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share[F.col("lang")])
    counted = (sample.mapInArrow(_count_trigrams, "lang string, bucket int, n bigint")
               .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect())
    counts = np.full((BUCKETS, len(langs)), SMOOTHING)
    place = {k: i for i, k in enumerate(langs)}
    for r in counted:
        counts[r["bucket"], place[r["lang"]]] += r["n"]
    return Model(langs, np.log(counts / counts.sum(axis=0)).astype(np.float32))


def _mixture(ll: np.ndarray, starts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(proportions, log-likelihoods) of each document by EM; rows of ll are words, starts their first word."""
    n = np.diff(np.append(starts, len(ll)))
    top = ll.max(axis=1, keepdims=True)
    p = np.exp(ll - top)
    theta = np.full((len(starts), ll.shape[1]), 1 / ll.shape[1])
    for k in range(rounds + 1):
        joint = p * np.repeat(theta, n, axis=0)
        total = joint.sum(axis=1, keepdims=True)
        if k == rounds:
            break
        theta = np.add.reduceat(joint / total, starts, axis=0) / n[:, None]
    return theta, np.add.reduceat((np.log(total) + top)[:, 0], starts)


def _best_set(ll: np.ndarray, theta: np.ndarray, single: np.ndarray, n: int) -> tuple[list[int], list[float]]:
    """Languages and shares of one document, by BIC over the sets of its most frequent languages."""
    order = np.argsort(-theta, kind="stable")
    best = int(np.argmax(single))
    found, score = ([best], [1.0]), -2 * float(single[best])
    for k in range(2, len(order) + 1):
        part = ll[:, order[:k]]
        share, fit = _mixture(part, np.zeros(1, dtype=np.int64))
        bic = -2 * float(fit[0]) + PENALTY * (k - 1) * np.log(n)
        if bic >= score:
            break
        rank = np.argsort(-share[0], kind="stable")
        found, score = ([int(order[i]) for i in rank], [float(share[0][i]) for i in rank]), bic
    return found


def identify(texts: list[str | None], model: Model) -> list[dict]:
    """Language, score and language set of each text."""
    out: list[dict | None] = [None] * len(texts)
    at = 0
    while at < len(texts):
        docs, folded, size = [], [], 0
        while at < len(texts) and size < GROUP_BYTES:
            data = fold(texts[at]) if model.langs and has_letter(texts[at]) else b""
            if data.strip():
                docs.append(at)
                folded.append(data)
                size += len(data)
            at += 1
        if not docs:
            continue
        data = np.frombuffer(b" " + b" ".join(folded) + b" ", dtype=np.uint8)
        limits = np.cumsum([1] + [len(t) + 1 for t in folded])[:-1]
        places, buckets = _trigrams(data)
        word = np.flatnonzero(np.concatenate(([True], np.diff(places) > 1)))
        ll = np.add.reduceat(model.logp[buckets], word, axis=0).astype(np.float64)
        first = np.searchsorted(places[word], limits)
        n = np.diff(np.append(first, len(word)))
        theta, fit = _mixture(ll, first)
        single = np.add.reduceat(ll, first, axis=0)
        for i, doc in enumerate(docs):
            best = int(np.argmax(single[i]))
            # the mixture of all languages fits best of all sets, so this test misses no set
            if 2 * (fit[i] - single[i, best]) > PENALTY * np.log(n[i]) and len(model.langs) > 1:
                langs, shares = _best_set(ll[first[i]:first[i] + n[i]], theta[i], single[i], int(n[i]))
            else:
                langs, shares = [best], [1.0]
            score = shares[0] if len(langs) > 1 else float(1 / np.exp(np.clip(single[i] - single[i, best], -700, 0)).sum())
            out[doc] = {"lang": model.langs[langs[0]], "score": min(1.0, max(0.0, score)),
                        "langs": [model.langs[k] for k in langs], "shares": shares}
    return [x or {"lang": UNKNOWN, "score": 0.0, "langs": [], "shares": []} for x in out]


RESULT = "struct<lang:string,score:double,langs:array<string>,shares:array<double>>"


def identify_languages(docs: DataFrame, model: Model, text: str = "text") -> tuple[DataFrame, str]:
    """(docs with one more column, its name): struct of lang, score, langs, shares.

    ``und`` with score 0 for a null text, a text without a letter, or a model
    without languages.  Every input column stays; each row is judged by its text alone.
    """
    name = fresh_name(docs.columns, "language")
    held = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers per learned language

    def run(column: pa.Array) -> pa.Array:
        return pa.array(identify(column.to_pylist(), held.value), pa.struct([
            ("lang", pa.string()), ("score", pa.float64()), ("langs", pa.list_(pa.string())),
            ("shares", pa.list_(pa.float64()))]))

    return docs.withColumn(name, F.arrow_udf(run, RESULT)(F.col(text).cast("string"))), name


def labelled_rows(docs: DataFrame, key: str = "doc_id", parts: int = 3, held: int = 1) -> DataFrame:
    """Rows that may be learned from: crc32 of the key, as text, modulo ``parts`` is not ``held``."""
    return docs.where(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % parts != held)


def keep_known(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id",
               min_share: float = MIN_SHARE) -> DataFrame:
    """The rows, unchanged, whose text has a language that holds ``min_share`` of it."""
    model = learn(labelled_rows(docs, key), lang, text)
    marked, name = identify_languages(docs, model, text)
    found = F.col(name)
    return marked.where((found["lang"] != UNKNOWN) & (found["shares"][0] >= min_share)).drop(name)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, langs."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = learn(labelled_rows(docs))
    marked, name = identify_languages(docs.select("doc_id", "text"), model)
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1
    return marked.select("doc_id", held.alias("held_out"), F.col(name)["lang"].alias("lang_pred"),
                         F.col(name)["score"].alias("score"), F.array_join(F.col(name)["langs"], ",").alias("langs"))
