"""Quality rules with robust multivariate outliers (operator 6).

Each document has a vector of transformed text statistics.  Per language and
source a minimum-covariance-determinant estimate (FAST-MCD: several starts,
concentration steps on half of the rows, the lowest determinant, one reweighted
step) gives a centre and a scatter that a minority of odd documents does not
move, and documents whose Mahalanobis distance is beyond the cut-off are
rejected.  Every step is an aggregate over the narrow table of statistics, so a
group may hold any share of all documents.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import Scratch, fresh_name
from .textops import WHITESPACE, as_bytes

SYMBOLS = b"#*$%&|<>"
CONTINUATION = bytes(range(0x80, 0xC0))
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
DIMENSIONS = 5
FLOORS = (0.25, 0.05, 0.10, 0.15, 0.15)  # least standard deviation that each transformed statistic is taken to have
KEPT_SHARE = 0.5       # share of a group that a concentration step rests on
STEPS = 6              # concentration steps of each start
RANDOM_STARTS = 2      # starts from a fifth of the rows, besides the quartiles and all rows
CUTOFF = 20.515        # 0.999 quantile of chi-squared with 5 degrees of freedom
WITHIN = 12.833        # 0.975 quantile: rows of the reweighted step
WITHIN_SCALE = 1.055   # variance of normal rows over that of the ones within
MEDIAN = 4.351         # the median
MIN_GROUP = 50         # smaller groups are judged with the other small sources of their language
BIN = 32               # distance bins per octave
BATCH_TEXTS = 256


def text_stats(text: bytes) -> tuple[int, ...]:
    """STATS of one text."""
    words = text.split()
    n = len(words)
    chars = len(text.translate(None, WHITESPACE + CONTINUATION))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [line for line in text.split(b"\n") if line.strip(WHITESPACE)]
    repeated = 0
    if n >= 4:
        ids: dict[bytes, int] = {}
        w = np.array([ids.setdefault(x, len(ids)) for x in words], dtype=np.int64)
        if len(ids) < 2_000_000:  # three word numbers fit one 64-bit number
            windows = (w[:-2] * len(ids) + w[1:-1]) * len(ids) + w[2:]
        else:
            pairs = np.unique(w[:-1] * len(ids) + w[1:], return_inverse=True)[1]
            windows = pairs[:-1] * len(ids) + w[2:]
        order = np.argsort(windows, kind="stable")
        same = windows[order][1:] == windows[order][:-1]
        if same.any():
            twice = np.zeros(len(windows), dtype=bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            covered = np.zeros(n, dtype=bool)
            for k in range(3):
                covered[k:k + len(windows)] |= twice
            repeated = int(covered.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeated, len(lines)


def _measure(column: pa.Array) -> pa.Array:
    rows = []
    for at in range(0, len(column), BATCH_TEXTS):
        rows += [text_stats(t) for t in as_bytes(column.slice(at, BATCH_TEXTS))]
    columns = list(zip(*rows)) if rows else [()] * len(STATS)
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(STATS))


def statistics(text: Column) -> Column:
    """Struct of STATS; a null text has none of anything."""
    return F.arrow_udf(_measure, "struct<" + ",".join(f"{s}:bigint" for s in STATS) + ">")(text.cast("string"))


def vector(s: Column) -> Column:
    """Transformed statistics: lengths on a log scale, shares as square roots."""
    n = F.greatest(s["n_words"], F.lit(1)).cast("double")
    return F.array(F.log(n), F.log(F.greatest(s["word_chars"], F.lit(1)) / n), F.sqrt(s["n_symbols"] / n),
                   F.sqrt(s["n_dup_lines"] / F.greatest(s["n_lines"], F.lit(1))), F.sqrt(s["n_repeat_words"] / n))


def base_failed(s: Column) -> Column:
    return (s["n_words"] < MIN_WORDS) | (s["n_repeat_words"] * 100 > s["n_words"] * MAX_REPEAT_PERCENT)


def _invert(batches):
    """Scatter of each group -> its inverse, with the floors on the diagonal."""
    for rows in batches:
        out = []
        for row in rows.itertuples(index=False):
            m = np.array(row.sums) / row.n
            second = np.zeros((DIMENSIONS, DIMENSIONS))
            second[np.triu_indices(DIMENSIONS)] = np.array(row.squares) / row.n
            second = second + np.triu(second, 1).T
            cov = second - np.outer(m, m) + np.diag(np.square(FLOORS))
            out.append((row.grp, row.start, np.round(m, 9).tolist(), np.round(np.linalg.inv(cov), 6).ravel().tolist(), 1.0,
                        round(float(np.linalg.slogdet(cov)[1]), 9)))
        yield pd.DataFrame(out, columns=["grp", "start", "m", "inv", "scale", "volume"])


ESTIMATE = "grp string, start int, m array<double>, inv array<double>, scale double, volume double"


def _distance() -> Column:
    """Squared Mahalanobis distance of v under (m, inv, scale)."""
    d = [F.col("v")[i] - F.col("m")[i] for i in range(DIMENSIONS)]
    terms = [d[i] * d[j] * F.col("inv")[i * DIMENSIONS + j] for i in range(DIMENSIONS) for j in range(DIMENSIONS)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return F.greatest(total, F.lit(0.0)) / F.col("scale")


def _distance_bin() -> Column:
    return F.floor(F.log2(F.lit(1.0) + _distance()) * BIN).cast("int")


def _quantile_bins(table: DataFrame, estimate: DataFrame, share: float) -> DataFrame:
    """(grp, start, cut): the lowest distance bin up to which each estimate of a group has ``share`` of its rows.

    Counted from a histogram per group, so a group is a bounded number of rows whatever its size.
    """
    counts = (table.join(estimate, "grp").groupBy("grp", "start", _distance_bin().alias("b"))
              .agg(F.count(F.lit(1)).alias("c")))
    run = Window.partitionBy("grp", "start").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("c").over(Window.partitionBy("grp", "start"))
    return (counts.select("grp", "start", "b", F.sum("c").over(run).alias("cum"), total.alias("n"))
            .where(F.col("cum") >= F.col("n") * share).groupBy("grp", "start").agg(F.min("b").alias("cut")))


def _estimate(rows: DataFrame) -> DataFrame:
    v = F.col("v")
    squares = [F.sum(v[i] * v[j]) for i in range(DIMENSIONS) for j in range(i, DIMENSIONS)]
    sums = rows.groupBy("grp", "start").agg(F.count(F.lit(1)).alias("n"),
                                   F.array(*[F.sum(v[i]) for i in range(DIMENSIONS)]).alias("sums"),
                                   F.array(*squares).alias("squares"))
    return sums.mapInPandas(_invert, ESTIMATE)


def robust_estimates(table: DataFrame, scratch: Scratch) -> DataFrame:
    """(grp, m, inv, scale) of a table (grp, v): the MCD centre, inverse scatter and consistency scale.

    The starts are the median and spread of each coordinate, all rows, and
    random fifths of the rows.  Each step keeps the half of the rows nearest to
    a start's last estimate and estimates again; the start that ends with the
    lowest determinant counts, and a last step takes all rows near to it.
    """
    v = F.col("v")
    diagonal = [F.pow(F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(FLOORS[i])), F.lit(-2.0))
                for i in range(DIMENSIONS)]
    start = (table.groupBy("grp").agg(*[F.percentile_approx(v[i], [0.25, 0.5, 0.75], 1000).alias(f"q{i}")
                                        for i in range(DIMENSIONS)])
             .select("grp", F.lit(0).alias("start"), F.array(*[F.col(f"q{i}")[1] for i in range(DIMENSIONS)]).alias("m"),
                     F.array(*[diagonal[i] if i == j else F.lit(0.0) for i in range(DIMENSIONS)
                               for j in range(DIMENSIONS)]).alias("inv"), F.lit(1.0).alias("scale"), F.lit(0.0).alias("volume")))
    fifths = [F.when(F.pmod(F.xxhash64("v", F.lit(k)), F.lit(5)) == 0, F.lit(2 + k)) for k in range(RANDOM_STARTS)]
    others = table.select("grp", "v", F.explode(F.array(F.lit(1), *fifths)).alias("start")).where("start is not null")
    estimate, path = scratch.store(start.union(_estimate(others)))
    for _ in range(STEPS):
        cut = _quantile_bins(table, estimate, KEPT_SHARE)
        near = table.join(estimate.join(cut, ["grp", "start"]), "grp").where(_distance_bin() <= F.col("cut"))
        estimate, new = scratch.store(_estimate(near.select("grp", "start", "v")))
        scratch.drop(path)
        path = new
    best = estimate.groupBy("grp").agg(F.min(F.struct("volume", "start", "m", "inv", "scale")).alias("b")).select("grp", "b.*")
    # the scatter of the inner rows is not that of all; make the median distance that of the normal distribution
    middle = _quantile_bins(table, best, 0.5)
    scaled = best.join(middle, ["grp", "start"]).select(
        "grp", "start", "m", "inv", ((F.pow(F.lit(2.0), (F.col("cut") + 0.5) / BIN) - 1) / MEDIAN).alias("scale"))
    scaled, _ = scratch.store(scaled)
    near = table.join(scaled, "grp").where(_distance() <= WITHIN).select("grp", "start", "v")
    return scratch.store(_estimate(near).select("grp", "m", "inv", F.lit(WITHIN_SCALE).alias("scale")))[0]


def judge_quality(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", lang: str = "lang",
                  source: str = "source", cutoff: float = CUTOFF) -> tuple[DataFrame, str]:
    """(table of the ``keep`` columns and one more, its name): struct of STATS, base_failed, distance, kept.

    One row per input row.  Null languages and sources are groups of their own.
    A null or empty text fails the base rules.  Documents that fail them take
    no part in the estimates.  Sources of fewer than MIN_GROUP other documents are
    pooled by language; a pool that is still smaller judges nothing and its documents are kept.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    name = fresh_name(list(keep), "quality")
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    stats = docs.select(F.struct(*[F.col(c) for c in keep]).alias("row"), part(lang).alias("l"), part(source).alias("s"),
                        statistics(F.col(text)).alias("stats"))
    stats, _ = scratch.store(stats.withColumn("v", vector(F.col("stats"))).withColumn("bad", base_failed(F.col("stats"))))
    sizes, _ = scratch.store(stats.groupBy("l", "s").agg(F.sum((~F.col("bad")).cast("int")).alias("n")))
    groups = sizes.select("l", "s", F.when(F.col("n") >= MIN_GROUP, F.concat_ws("/", F.lit("own"), "l", "s"))
                          .otherwise(F.concat_ws("/", F.lit("pool"), "l")).alias("grp"), "n")
    pools = groups.groupBy("grp").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_GROUP).select("grp")
    groups, _ = scratch.store(groups.drop("n").join(pools.withColumn("judged", F.lit(True)), "grp", "left"))
    grouped = stats.join(groups, ["l", "s"])
    estimate = robust_estimates(grouped.where("judged and not bad").select("grp", "v"), scratch)
    placed = grouped.join(estimate, "grp", "left").withColumn("distance", _distance())
    return placed.select("row.*", F.struct("stats.*", F.col("bad").alias("base_failed"), "distance", (
        ~F.col("bad") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= cutoff)).alias("kept")).alias(name)), name


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    judged, name = judge_quality(docs)
    return judged.select("doc_id", *[F.col(f"{name}.{c}") for c in (*STATS[:5], "base_failed", "kept", "distance")])
