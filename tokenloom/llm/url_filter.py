"""URL filters: host and path rules, and gradient-boosted trees on lexical features (operator 10).

DataFrame functions only.  Rules decide where they fit; every other URL is
judged by boosted trees over length, depth, digit ratio, entropy, parameter
counts and suffix statistics, trained from labelled URLs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import Scratch, fresh_name

TRAIN_ROWS = 100_000   # about so many labelled URLs are learned from, chosen by hash
SUFFIXES = 2_000       # most frequent host suffixes with a statistic of their own
PRIOR_ROWS = 20.0
TREES, DEPTH, SEED = 20, 4, 11
FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digit_ratio", "host_digits", "entropy",
            "params", "hyphens", "has_extension", "has_fragment", "longest_label", "suffix_rate")


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The rules of the registered query.
RULES = (Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"),
         Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"))


def host_of(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; '' without '://' or for null."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the end of the host up to '?', '#' or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def match_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits, null without one.

    A rule fits its host and all subdomains where the path starts with the rule's path.  Of
    equally long rules the first by name decides.
    """
    name = verdict = None
    for rule in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name = F.when(fits, rule.name) if name is None else name.when(fits, rule.name)
        verdict = F.when(fits, rule.verdict) if verdict is None else verdict.when(fits, rule.verdict)
    none = F.lit(None).cast("string")
    return (name if name is not None else none), (verdict if verdict is not None else none)


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def _entropy(text: Column) -> Column:
    """Shannon entropy, in bits, of the characters of a text."""
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    share = lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n
    return F.aggregate(F.array_distinct(F.filter(F.split(text, ""), lambda c: c != "")), F.lit(0.0),
                       lambda s, c: s - share(c) * F.log2(F.greatest(share(c), F.lit(1e-12))))


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def features(url: Column, host: Column, path: Column, rates: dict[str, float], prior: float) -> list[Column]:
    url = F.coalesce(url, F.lit(""))
    length = F.length(url).cast("double")
    rate = F.lit(prior)
    if rates:
        table = F.create_map(*[F.lit(x) for kv in sorted(rates.items()) for x in kv])
        rate = F.coalesce(F.try_element_at(table, suffix_of(host)), F.lit(prior))
    values = {
        "length": length, "host_length": F.length(host).cast("double"), "path_length": F.length(path).cast("double"),
        "depth": _count(path, "/"), "labels": _count(host, r"\."), "digit_ratio": _count(url, "[0-9]") / F.greatest(length, F.lit(1.0)),
        "host_digits": _count(host, "[0-9]"), "entropy": _entropy(url), "params": _count(url, "[?&][^=&#]+="),
        "hyphens": _count(host, "-"), "has_extension": path.rlike(r"\.[A-Za-z0-9]{1,5}$").cast("double"),
        "has_fragment": url.contains("#").cast("double"),
        "longest_label": F.array_max(F.transform(F.split(host, r"\."), F.length)).cast("double"), "suffix_rate": rate}
    return [values[f].alias(f) for f in FEATURES]


class UrlModel:
    """Boosted trees with the suffix statistics that their features need."""

    def __init__(self, trees, rates: dict[str, float], prior: float):
        self.trees, self.rates, self.prior = trees, rates, prior


def learn(labelled: DataFrame, url: str = "url", blocked: str = "blocked", rows: int = TRAIN_ROWS) -> UrlModel:
    """Learn from (url, blocked) rows; rows with a null in either do not count.

    With one class or none there are no trees, and the share of blocked rows (0 without rows) judges all.
    """
    scratch = Scratch(labelled.sparkSession, "urls")
    known = labelled.where(F.col(url).isNotNull() & F.col(blocked).isNotNull()).select(
        F.col(url).cast("string").alias("url"), F.col(blocked).cast("double").alias("label"))
    share = min(1.0, rows / max(1, known.count()))
    sample, path = scratch.store(known.where(F.pmod(F.xxhash64("url"), F.lit(1 << 20)) < int(share * (1 << 20)))
                                 .withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url"))))
    total = sample.agg(F.count(F.lit(1)), F.sum("label")).first()
    n, pos = total[0], total[1] or 0.0
    prior = pos / n if n else 0.0
    if not 0 < pos < n:
        scratch.drop(path)
        return UrlModel(None, {}, prior)
    tops = (sample.groupBy(suffix_of(F.col("host")).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p"))
            .orderBy(F.desc("n"), "s").limit(SUFFIXES).collect())
    rates = {r["s"]: (r["p"] + prior * PRIOR_ROWS) / (r["n"] + PRIOR_ROWS) for r in tops}
    table = sample.select("label", *features(F.col("url"), F.col("host"), F.col("path"), rates, prior))
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(table).select("label", "features")
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED).fit(vectors)
    scratch.drop(path)
    return UrlModel(trees, rates, prior)


def judge_urls(pages: DataFrame, model: UrlModel, url: str = "url", rules=RULES) -> tuple[DataFrame, str]:
    """(pages with one more column, its name): struct of host, path, rule, blocked_probability, verdict.

    A null URL, or one without '://', has empty host and path and is judged
    like any other.  Every input column stays; each row is judged by its URL alone.
    """
    names = []
    for base in ("host", "path", "features", "rawPrediction", "probability", "prediction", "judged", *FEATURES):
        names.append(fresh_name(pages.columns + names, "url_" + base))
    host, path, vector, raw, probability, prediction, judged, *columns = names
    out = pages.withColumn(host, host_of(F.col(url))).withColumn(path, path_of(F.col(url)))
    rule, decided = match_rule(F.col(host), F.col(path), rules)
    if model.trees is None:
        chance = F.lit(float(model.prior))
    else:
        values = features(F.col(url).cast("string"), F.col(host), F.col(path), model.rates, model.prior)
        out = out.select("*", *[v.alias(c) for v, c in zip(values, columns)])
        out = VectorAssembler(inputCols=columns, outputCol=vector, handleInvalid="keep").transform(out)
        trees = (model.trees.copy().setFeaturesCol(vector).setRawPredictionCol(raw).setProbabilityCol(probability)
                 .setPredictionCol(prediction))
        out = trees.transform(out)
        chance = vector_to_array(F.col(probability))[1]
    verdict = F.coalesce(decided, F.when(chance >= 0.5, "block").otherwise("allow"))
    result = F.struct(F.col(host).alias("host"), F.col(path).alias("path"), rule.alias("rule"),
                      chance.alias("blocked_probability"), verdict.alias("verdict")).alias(judged)
    return out.select(*pages.columns, result), judged


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, blocked_probability.

    The URLs that a rule decides are the labelled ones: they train the trees that judge the others.
    """
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    _, decided = match_rule(host_of(F.col("url")), path_of(F.col("url")))
    model = learn(pages.select("url", (decided == "block").cast("double").alias("blocked")))
    judged, name = judge_urls(pages, model)
    return judged.select("page_id", *[F.col(f"{name}.{c}") for c in ("host", "path", "rule", "verdict",
                                                                    "blocked_probability")])
