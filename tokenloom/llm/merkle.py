"""Merkle dataset manifest, proved by a recursive query (operator 12).

Every row of a dataset is a leaf.  The leaves of a group (language) form a tree
in key order, and the groups' roots form the tree above them.  A tree is stored as rows of
runs: the digests of up to eight neighbours, with a link to the run that has
the parent among its own.  A recursive query starts at every leaf and climbs these links: each step
appends the siblings of the run as one row of the leaf's proof and folds the leaf's digest with them.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import Scratch

RUN = 8               # neighbours that share a parent
SALT_LEAVES = 1 << 12  # a run with more leaves below it is read from several copies
NEAR_LEAVES = 1 << 12  # neighbours whose proofs are gathered by one task
TOP = -1              # the tree over the groups' roots
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


class Manifest(NamedTuple):
    """leaves: n (order), row, leaf, folded, subroot, link; runs: the trees; root: hex, None without leaves."""

    leaves: DataFrame
    runs: DataFrame
    root: str | None


def digest(value: Column) -> Column:
    """sha256 as 32 bytes."""
    return F.unhex(F.sha2(value, 256))


def to_hex(value: Column) -> Column:
    return F.lower(F.hex(value))


def leaf_digest(fields: list[Column]) -> Column:
    """Digest of a row: each field as byte count, colon, value, or ``-`` for null."""
    texts = [f.cast("string") for f in fields]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-"))
                             for t in texts]))


def _numbered(df: DataFrame, order: list[str], scratch: Scratch) -> DataFrame:
    """Stored ``df`` with n = 0, 1, 2, ... in the order of the columns: ranges, numbered each after those before it."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged, path = scratch.store(df.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    before = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("c"))
    before = before.select("part", (F.sum("c").over(Window.orderBy("part")) - F.col("c")).alias("before"))
    within = Window.partitionBy("part").orderBy(*order)
    numbered, _ = scratch.store(ranged.join(F.broadcast(before), "part")  # a row a partition
                                .withColumn("n", F.row_number().over(within) - 1 + F.col("before"))
                                .drop("part", "before"))
    scratch.drop(path)
    return numbered


def _link(tree: Column, level: int, index: Column, leaves: Column) -> list[Column]:
    """Link of node ``index`` of a level to its run: tree, level, run, place in it, copies of the run.

    ``leaves`` is the number of leaves below the whole tree; a run of this level covers at most RUN ** (level + 1).
    """
    below = F.least(leaves, F.lit(min(RUN ** (level + 1), 1 << 62)).cast("bigint"))
    return [tree.cast("bigint").alias("up_tree"), F.lit(level).alias("up_level"), F.floor(index / RUN).alias("up_run"),
            (index % RUN).cast("int").alias("up_pos"), F.ceil(below / SALT_LEAVES).cast("bigint").alias("up_salts")]


def _tree(nodes: DataFrame, scratch: Scratch) -> tuple[list[DataFrame], DataFrame]:
    """(stored runs by level, roots) of the trees over nodes (tree, i, digest, width, leaves).

    width is the number of nodes of a tree in this level, leaves that of the leaves below the whole tree.
    """
    levels, roots, level = [], [nodes.where("width = 1").select("tree", "digest")], 0
    widest = nodes.agg(F.max("width")).first()[0] or 0
    while widest > 1:
        run = F.floor(F.col("i") / RUN)
        children = F.sort_array(F.collect_list(F.struct("i", "digest")))  # RUN at most
        runs = (nodes.where("width > 1").groupBy("tree", run.alias("run"))
                .agg(children.alias("c"), F.first("width").alias("width"), F.first("leaves").alias("leaves"))
                .select("tree", F.lit(level).alias("level"), "run", F.ceil(F.col("width") / RUN).alias("width"), "leaves",
                        F.aggregate("c", F.lit(b""), lambda a, x: F.concat(a, x["digest"])).alias("children")))
        runs, _ = scratch.store(runs.withColumn("digest", digest(to_hex(F.col("children")))))
        levels.append(runs)
        nodes = runs.select("tree", F.col("run").alias("i"), "digest", "width", "leaves")
        roots.append(nodes.where("width = 1").select("tree", "digest"))
        widest, level = -(-widest // RUN), level + 1
    out = roots[0]
    for r in roots[1:]:
        out = out.union(r)
    return levels, out


def _linked(levels: list[DataFrame], top: Column | None) -> list[DataFrame]:
    """Runs with the links of their parent nodes; roots have the link ``top`` (array of its parts), or none."""
    out = []
    for level, runs in enumerate(levels):
        own = F.struct(*_link(F.col("tree"), level + 1, F.col("run"), F.col("leaves")))
        up = F.when(F.col("width") > 1, own)
        up = up.otherwise(top) if top is not None else up
        salts = F.ceil(F.least(F.col("leaves"), F.lit(min(RUN ** (level + 1), 1 << 62))) / SALT_LEAVES).cast("int")
        out.append(runs.withColumn("up", up).withColumn("salt", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1)))
                   .select("tree", "level", "run", "salt", "children", "up.*"))
    return out


def build_manifest(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), group: str = "lang", key: str = "doc_id",
                   fields: tuple[str, ...] = FIELDS, claimed: dict[str, Column] | None = None,
                   scratch: Scratch | None = None) -> Manifest:
    """The manifest of ``docs``: leaves, stored trees, the groups' roots and the root.

    A leaf is the digest of ``fields``.  Groups are ordered by their UTF-8 bytes, null first;
    leaves of a group by key, null first, equal keys by leaf, so the order of the input and repeated
    rows do not matter.  ``claimed`` gives other values of some fields: ``folded`` is the digest
    with them, which a proof has to carry to the root.  A group of one leaf has
    that leaf as its root; an empty table has no root.
    """
    scratch = scratch or Scratch(docs.sparkSession, "merkle")
    claimed = claimed or {}
    grp = F.coalesce(F.concat(F.lit("s"), F.col(group).cast("string")), F.lit("n"))
    rows, path = scratch.store(docs.select(
        F.struct(*[F.col(c) for c in keep]).alias("row"), grp.alias("grp"), F.col(key).alias("key"),
        leaf_digest([F.col(f) for f in fields]).alias("leaf"),
        leaf_digest([claimed.get(f, F.col(f)) for f in fields]).alias("folded")))
    rows = _numbered(rows.withColumn("at", F.monotonically_increasing_id()), ["grp", "key", "leaf", "at"], scratch)
    scratch.drop(path)
    groups = rows.groupBy("grp").agg(F.min("n").alias("tree"), F.count(F.lit(1)).alias("width"))
    groups = _numbered(groups, ["grp"], scratch).withColumnRenamed("n", "place")
    total = groups.agg(F.count(F.lit(1)), F.sum("width")).first()
    leaves = rows.join(groups.select("grp", "tree", "width", "place"), "grp")
    i = F.col("n") - F.col("tree")
    levels, subroots = _tree(leaves.select("tree", i.alias("i"), F.col("leaf").alias("digest"), "width",
                                           F.col("width").alias("leaves")), scratch)
    every = F.lit(total[1] or 0).cast("bigint")
    top = F.struct(*_link(F.lit(TOP), 0, F.col("place"), every)) if total[0] > 1 else None
    if top is not None:  # a run of group roots has any number of leaves below it
        top = top.withField("up_salts", F.ceil(every / SALT_LEAVES).cast("bigint"))
    groups, _ = scratch.store(groups.join(subroots, "tree")
                              .select("tree", "place", F.col("digest").alias("subroot")))
    upper, root = _tree(groups.select(F.lit(TOP).cast("bigint").alias("tree"), F.col("place").alias("i"),
                                      F.col("subroot").alias("digest"), F.lit(total[0]).cast("bigint").alias("width"),
                                      every.alias("leaves")), scratch)
    found = root.select(to_hex(F.col("digest"))).first()
    placed = [r.join(groups.select("tree", "place"), "tree") for r in levels]
    runs = _linked(placed, top)
    for level, r in enumerate(upper):
        copies = F.sequence(F.lit(0), F.ceil(every / SALT_LEAVES).cast("int") - 1)
        own = F.struct(*_link(F.lit(TOP), level + 1, F.col("run"), every)).withField(
            "up_salts", F.ceil(every / SALT_LEAVES).cast("bigint"))
        runs.append(r.withColumn("up", F.when(F.col("width") > 1, own)).withColumn("salt", F.explode(copies))
                    .select("tree", "level", "run", "salt", "children", "up.*"))
    stored = docs.sparkSession.createDataFrame(
        [], "tree bigint, level int, run bigint, salt int, children binary, up_tree bigint, up_level int, up_run bigint, "
            "up_pos int, up_salts bigint")
    for r in runs:
        stored = stored.unionByName(r)
    stored, _ = scratch.store(stored)
    first = F.struct(*_link(F.col("tree"), 0, i, F.col("width")))
    first = F.when(F.col("width") > 1, first)
    first = first.otherwise(top) if top is not None else first
    leaves, _ = scratch.store(leaves.withColumn("up", first).join(groups.select("tree", "subroot"), "tree")
                              .select("n", "row", "leaf", "folded", "subroot", "up.*"))
    return Manifest(leaves, stored, found[0] if found else None)


CLIMB = """
WITH RECURSIVE climb (n, step, tree, level, run, salt, pos, folded, siblings) AS (
  SELECT n, 0, up_tree, up_level, up_run, CAST(pmod(n, up_salts) AS INT), up_pos, folded, CAST('' AS BINARY) FROM {leaves}
  UNION ALL
  SELECT c.n, c.step + 1, r.up_tree, r.up_level, r.up_run, CAST(pmod(c.n, r.up_salts) AS INT), r.up_pos,
         unhex(sha2(lower(hex(concat(substring(r.children, 1, 32 * c.pos), c.folded,
                                     substring(r.children, 32 * c.pos + 33)))), 256)),
         concat(substring(r.children, 1, 32 * c.pos), substring(r.children, 32 * c.pos + 33))
  FROM climb c JOIN {runs} r ON c.tree = r.tree AND c.level = r.level AND c.run = r.run AND c.salt = r.salt)
SELECT n, step, folded, siblings FROM climb
"""


def climb(manifest: Manifest, scratch: Scratch) -> DataFrame:
    """Leaves with proof (siblings level by level) and folded (the digest that came out on top) of the recursive ascent.

    The rows of neighbouring leaves are gathered together, since they share the siblings of all upper levels.
    """
    spark = manifest.leaves.sparkSession
    names = {"leaves": f"leaves_{scratch.name}", "runs": f"runs_{scratch.name}"}
    manifest.leaves.createOrReplaceTempView(names["leaves"])
    manifest.runs.createOrReplaceTempView(names["runs"])
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")  # a guard against endless recursion; links only lead upwards
    try:
        steps = spark.sql(CLIMB.format(**names)).unionByName(
            manifest.leaves.select("n", F.struct("row", "leaf", "subroot").alias("of")), allowMissingColumns=True)
        near = F.floor(F.col("n") / NEAR_LEAVES).alias("near")
        steps = steps.select("*", near).repartition("near").groupBy("near", "n").agg(
            F.sort_array(F.collect_list(F.when(F.col("step").isNotNull(), F.struct("step", "siblings", "folded"))))
            .alias("s"), F.first("of", ignorenulls=True).alias("of"))  # one a level
        proof = F.aggregate("s", F.lit(b""), lambda a, x: F.concat(a, x["siblings"]))
        return scratch.store(steps.select("n", "of.*", proof.alias("proof"), F.element_at("s", -1)["folded"].alias("folded"))
                             .sortWithinPartitions("n"), compression="zstd")[0]
    finally:
        spark.conf.set(limit, before)
        for name in names.values():
            spark.catalog.dropTempView(name)


def prove(manifest: Manifest, scratch: Scratch | None = None) -> DataFrame:
    """(row, leaf, subroot, root, proof, folded_root, verified) per leaf; digests and proof as hex text.

    proof is the leaf's siblings, from its run up to the root's, left to right.  verified says whether the
    claimed leaf, folded with these siblings, gives the root.
    """
    climbed = climb(manifest, scratch or Scratch(manifest.leaves.sparkSession, "merkle"))
    hexed = {c: to_hex(F.col(c)) for c in ("leaf", "subroot", "proof")} | {"folded_root": to_hex(F.col("folded"))}
    root = F.lit(manifest.root).cast("string")
    return (climbed.withColumns(hexed).withColumns({"root": root, "verified": F.col("folded_root") == root})
            .select("row", "leaf", "subroot", "root", "proof", "folded_root", "verified"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; a third of the texts is tampered."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    text = F.when(tampered, F.translate("text", upper, upper.lower())).otherwise(F.col("text"))
    proved = prove(build_manifest(docs, claimed={"text": text}))
    return proved.select(F.col("row.doc_id").alias("doc_id"), "leaf", "subroot", "root",
                         F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")
