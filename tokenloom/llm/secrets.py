"""Secret scans with a randomness test battery (operator 2), in DataFrame functions only.

Base secrets are found by three patterns.  The method adds random-looking
tokens: the encoding of each token is inferred from its characters, and three
tests ask whether its symbols are uniform and independent over that alphabet: chi-squared
uniformity, runs above and below the middle, and lag-one serial correlation.
Their p-values are combined by Fisher's rule.  Random tokens have uniform
p-values and texts have p-values near zero, so per encoding and length class
the share of random tokens is estimated from the corpus histogram of p-values,
and the cut-off is the lowest at which the estimated share of false discoveries stays
under ``q``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import fresh_name

ASSIGN = (r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?"
          r"([A-Za-z0-9+/_.=-]+)")
ASSIGN_VALUE = 12
ACCESS = "AKIA[A-Z0-9]{14,}"  # a run of 18 or more; a shorter run has no match inside it
HEX = "[0-9a-f]{16,}"
MIN_TOKEN = 20
TOKEN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{%d,}"
FALSE_DISCOVERIES = 0.1
P_BINS = 50
BORROWED = 20       # tokens that a histogram takes from the wider one it is shrunk to
CHUNK = 256
MASK = "[SECRET]"

SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"
KINDS = ("assign", "access", "hex", "random")


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0).cast("bigint"), lambda s, x: s + x)


def _running(lengths: Column) -> Column:
    """Sum of all elements before each element; chunked, so the work stays far below the square of the size."""
    def per_chunk(sizes):
        sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / CHUNK).cast("int")),
                           lambda j: _total(F.slice(sizes, j * CHUNK + 1, F.lit(CHUNK))))
        return F.transform(sizes, lambda _, i: _total(F.slice(sums, F.lit(1), F.floor(i / CHUNK).cast("int")))
                           + _total(F.slice(sizes, (F.floor(i / CHUNK) * CHUNK + 1).cast("int"), i % CHUNK)))
    return F.when(F.size(lengths) > 0, per_chunk(lengths)).otherwise(F.array().cast("array<bigint>"))


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _pieces(text: Column, pattern: str) -> Column:
    return F.split(text, pattern, -1)


def _spans(text: Column, pattern: str, kind: int, keep) -> Column:
    """Spans of the matches that pass ``keep``: what lies before match i are the pieces up to i and the
    matches before it."""
    sizes = F.zip_with(F.transform(_pieces(text, pattern), F.length), F.transform(_matches(text, pattern), F.length),
                       lambda p, m: F.struct(p.cast("bigint").alias("p"), F.coalesce(m, F.lit(0)).cast("bigint").alias("m")))
    before = _running(F.transform(sizes, lambda s: s["p"] + s["m"]))
    spans = F.zip_with(F.zip_with(_matches(text, pattern), sizes, lambda t, s: F.struct(t.alias("t"), s.alias("s"))),
                       before, lambda x, b: F.struct(x["t"].alias("t"), (b + x["s"]["p"]).alias("start"),
                                                     (b + x["s"]["p"] + x["s"]["m"]).alias("end")))
    found = F.filter(spans, lambda x: x["t"].isNotNull() & keep(x["t"]))
    plain = F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"),
                                                  x["end"].alias("end"))).cast(SPANS)
    return F.when(text.rlike(pattern), plain).otherwise(F.array().cast(SPANS))


def _is_assign(match: Column) -> Column:
    return F.length(F.regexp_extract(match, ASSIGN, 2)) >= ASSIGN_VALUE


def _replace(text: Column, pattern: str, by) -> Column:
    """Text with each match put through ``by``; linear in the text."""
    parts = F.zip_with(_pieces(text, pattern), _matches(text, pattern),
                       lambda p, m: F.concat(F.coalesce(p, F.lit("")), F.when(m.isNull(), "").otherwise(by(m))))
    return F.when(text.rlike(pattern), F.array_join(parts, "")).otherwise(text)


def _without_assign(text: Column) -> Column:
    """Text with each assigned secret blanked, other characters where they were."""
    return _replace(text, ASSIGN, lambda m: F.when(_is_assign(m), F.repeat(F.lit(" "), F.length(m))).otherwise(m))


def encoding(token: Column) -> Column:
    """Size of the alphabet that the token's characters come from: 16, 32, 36 or 64."""
    return (F.when(token.rlike("^([0-9a-f]+|[0-9A-F]+)$"), 16).when(token.rlike("^[A-Z2-7]+$"), 32)
            .when(token.rlike("^([0-9a-z]+|[0-9A-Z]+)$"), 36).otherwise(64))


def _values(token: Column, size: Column) -> Column:
    """Each character's place in the inferred alphabet."""
    code = lambda c: F.ascii(c)
    digit = lambda c: c.between("0", "9")
    upper = lambda c: c.between("A", "Z")
    low = lambda c: F.ascii(F.lower(c)) - 97
    return F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: (
        F.when(size.isin(16, 36), F.when(digit(c), code(c) - 48).otherwise(low(c) + 10))
        .when(size == 32, F.when(digit(c), code(c) - 50 + 26).otherwise(low(c)))
        .when(upper(c), code(c) - 65).when(digit(c), code(c) - 48 + 52).when(c.isin("+", "-"), 62)
        .when(c.isin("/", "_"), 63).otherwise(code(c) - 97 + 26)).cast("double"))


def _two_sided(z: Column) -> Column:
    """P(|Z| >= |z|) of the normal distribution, logistic approximation."""
    a = F.least(F.abs(z), F.lit(8.0))
    return F.greatest(F.lit(2.0) / (F.lit(1.0) + F.exp(a * 1.5976 + F.pow(a, F.lit(3.0)) * 0.07056)), F.lit(1e-15))


def randomness(token: Column) -> Column:
    """Combined p-value of the three tests that the token is random over its inferred alphabet."""
    def tests(x: Column, size: Column) -> Column:
        n = F.size(x).cast("double")
        # chi-squared over bins of about three symbols of the token each
        bins = F.greatest(F.lit(4.0), F.least(size.cast("double"), F.floor(n / 3).cast("double")))
        counts = F.transform(F.sequence(F.lit(0), bins.cast("int") - 1), lambda j: F.size(
            F.filter(x, lambda v: F.floor(v * bins / size) == j)).cast("double"))
        chi = F.aggregate(counts, F.lit(0.0), lambda s, c: s + F.pow(c - n / bins, F.lit(2.0)) / (n / bins))
        df = bins - 1
        z_chi = (F.pow(chi / df, F.lit(1 / 3)) - (F.lit(1.0) - F.lit(2.0) / (df * 9))) / F.sqrt(F.lit(2.0) / (df * 9))
        # runs above and below the middle of the alphabet
        middle = (size - 1) / 2
        high = F.size(F.filter(x, lambda v: v > middle)).cast("double")
        low = n - high
        following = F.slice(x, F.lit(2), F.size(x) - 1)
        pairs = F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), following,
                           lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        runs = F.size(F.filter(pairs, lambda p: (p["a"] > middle) != (p["b"] > middle))).cast("double") + 1
        mean = high * low * 2 / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        z_runs = F.when(var > 0, (runs - mean) / F.sqrt(F.greatest(var, F.lit(1e-9)))).otherwise(F.lit(8.0))
        # lag-one serial correlation under the uniform distribution
        spread = (size * size - 1) / 12
        corr = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + (p["a"] - middle) * (p["b"] - middle)) / spread
        z_corr = corr / F.sqrt(n - 1)
        half = -(F.ln(_two_sided(z_chi)) + F.ln(_two_sided(z_runs)) + F.ln(_two_sided(z_corr)))
        return F.exp(-half) * (F.lit(1.0) + half + half * half / 2)
    # arrays of one element bind the inferred values once
    size = encoding(token)
    bound = F.transform(F.array(F.struct(_values(token, size).alias("x"), size.alias("k"))),
                        lambda s: tests(s["x"], s["k"]))
    return bound[0]


def _stratum(token: Column) -> Column:
    """Encoding and length class (half octaves), the groups in which discoveries are controlled."""
    return F.concat_ws("-", encoding(token).cast("string"),
                       F.floor(F.log2(F.length(token).cast("double")) * 2).cast("string"))


def _is_candidate(match: Column) -> Column:
    """Tokens that hold an access key or a hex run are base secrets already."""
    return ~match.rlike(f"{ACCESS}|{HEX}")


def token_pattern(min_token: int) -> str:
    return TOKEN % min_token


def cutoffs(docs: DataFrame, text: str = "text", min_token: int = MIN_TOKEN, q: float = FALSE_DISCOVERIES) \
        -> dict[str, float]:
    """Lowest accepted p-value per stratum, from the histogram over all tokens of all documents.

    The histogram has at most 4 alphabets x 2 x 31 length classes x 50 bins.
    Sparse strata borrow from their neighbours (``_limits``); a stratum without tokens accepts nothing.
    """
    pattern = token_pattern(min_token)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    tokens = (docs.select(body.alias("t")).where(F.col("t").rlike(pattern))
              .select(F.explode(_matches(_without_assign(F.col("t")), pattern)).alias("m")).where(_is_candidate(F.col("m"))))
    bins = F.least(F.floor(randomness(F.col("m")) * P_BINS), F.lit(P_BINS - 1)).cast("int")
    rows = tokens.groupBy(_stratum(F.col("m")).alias("s"), bins.alias("b")).agg(F.count(F.lit(1)).alias("c")).collect()
    counts: dict[tuple[int, int], list[int]] = {}
    for row in rows:
        size, length = row["s"].split("-")
        counts.setdefault((int(size), int(length)), [0] * P_BINS)[row["b"]] = row["c"]
    return {f"{size}-{length}": cut for (size, length), cut in _limits(counts, q).items()}


def _limits(counts: dict[tuple[int, int], list[int]], q: float) -> dict[tuple[int, int], float]:
    """(encoding, length class) -> histogram of p-values, to the lowest accepted p-value of each.

    A histogram is shrunk, by BORROWED tokens each time, to that of itself and its two
    neighbours in length, this to its encoding's, and this to one of random tokens and
    texts in equal parts.  Random tokens above a p-value are estimated from the upper
    half of the histogram, plus one standard error, so that an excess must be more than chance to move the cut-off.
    """
    start = [0.5 / P_BINS + 0.5 * (b == 0) for b in range(P_BINS)]

    def shrunk(c: list[int], toward: list[float]) -> list[float]:
        return [(x + BORROWED * t) / (sum(c) + BORROWED) for x, t in zip(c, toward)]

    def added(parts: list[list[int]]) -> list[int]:
        return [sum(xs) for xs in zip(*parts)]

    out = {}
    for (size, length), own in counts.items():
        whole = shrunk(added([c for (k, _), c in counts.items() if k == size]), start)
        near = shrunk(added([c for (k, at), c in counts.items() if k == size and abs(at - length) <= 1]), whole)
        c = [x + BORROWED * t for x, t in zip(own, near)]
        half = sum(c[P_BINS // 2:])
        random = min(sum(c), 2 * (half + math.sqrt(half)))
        for b in range(P_BINS):
            above = sum(c[b:])
            # an infinite stratum of random tokens would have this many above the cut-off
            if 1 - random * (1 - b / P_BINS) / above <= q:
                out[size, length] = max(b / P_BINS, 0.001)
                break
    return out


def _is_random(match: Column, cut: dict[str, float]) -> Column:
    if not cut:
        return F.lit(False)
    table = F.create_map(*[F.lit(x) for kv in sorted(cut.items()) for x in kv])
    limit = F.try_element_at(table, _stratum(match))
    return _is_candidate(match) & F.coalesce(randomness(match) >= limit, F.lit(False))


def find_secrets(docs: DataFrame, text: str = "text", min_token: int = MIN_TOKEN, q: float = FALSE_DISCOVERIES) \
        -> tuple[DataFrame, str]:
    """(docs with one more column, its name): all spans of a text, by start and kind.

    A span is (start, kind, end): code points, end exclusive; kind counts in KINDS.
    Every input column stays.  A null or empty text has no span.  Rows are judged one by
    one, so repeated rows get equal spans; an empty table stays empty.
    """
    cut = cutoffs(docs, text, min_token, q)
    name = fresh_name(docs.columns, "secrets")
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    whole = lambda _: F.lit(True)
    found = F.concat(_spans(body, ASSIGN, 0, _is_assign), _spans(body, ACCESS, 1, whole), _spans(body, HEX, 2, whole),
                     _spans(_without_assign(body), token_pattern(min_token), 3, lambda m: _is_random(m, cut)))
    return docs.withColumn(name, F.array_sort(found)), name


def redact(docs: DataFrame, text: str = "text", length_column: str = "n_chars", min_token: int = MIN_TOKEN,
           q: float = FALSE_DISCOVERIES) -> DataFrame:
    """The same rows with every secret replaced by ``MASK``; ``length_column``, if there is one, follows a changed text.

    A null text stays null.
    """
    cut = cutoffs(docs, text, min_token, q)
    pattern = token_pattern(min_token)
    body = F.col(text).cast("string")
    body = _replace(body, ASSIGN, lambda m: F.when(_is_assign(m), F.lit(MASK)).otherwise(m))
    body = F.regexp_replace(F.regexp_replace(body, ACCESS, MASK), HEX, MASK)
    body = _replace(body, pattern, lambda m: F.when(_is_random(m, cut), F.lit(MASK)).otherwise(m))
    old = fresh_name(docs.columns, "old_text")
    out = docs.withColumn(old, F.col(text)).withColumn(text, body)
    if length_column in docs.columns:
        kind = docs.schema[length_column].dataType
        out = out.withColumn(length_column, F.when(F.col(text) != F.col(old), F.length(text).cast(kind))
                             .otherwise(F.col(length_column)))
    return out.drop(old)


def _listed(spans: Column, last_kind: int) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.filter(spans, lambda s: s["kind"] <= last_kind), lambda s: F.concat_ws(
        ":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    marked, name = find_secrets(docs)
    spans = F.col(name)
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")
    return marked.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                         F.sha2(_listed(spans, 2), 256).alias("base_sha256"), _listed(spans, 3).alias("spans"),
                         count(3).alias("n_random"))
