"""Merkle manifest of a table of documents: subroots by source, a root over them, and a proof for every row.

H is the lowercase hex sha256 of its inputs end to end, digests as hex text. A leaf is H of doc_id, source, lang, n_chars
and text, each ``-`` if null, else its UTF-8 byte count, ``:`` and its value. In a source leaves stand by doc_id; while a
level has several nodes, every 16 neighbours (the last run: fewer, even one) become their H. Subroots stand by source,
null first, and become the root likewise.

Every node is labelled with the interval [lo, hi) of leaf ranks that it covers, so the tree needs no pointers:

1. Ranks. Rows are range-partitioned and sorted by (source, doc_id); a rank is the place inside the partition plus
   the rows of the same source in earlier partitions, so a source with most of the rows is spread over many tasks.
2. Labels, level by level: the nodes whose ``lo`` falls in one bucket of 16 ** level ranks become one node that covers
   their union and keeps them as its children. A level is a sixteenth of the one below.
3. Proofs, from the root down: each node meets its parent in a join on the bucket, checked by containment of the
   intervals. Its siblings are the parent's children less the one whose interval holds the node's own. It adds
   them to its parent's path, which all leaves below share. No key of these joins has more than 16 rows.

Null ids and sources are values of their own and stand first. Rows that repeat an id stand by their leaf; equal rows are
leaves of their own. Texts may be null or empty. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
WIDTH = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Tree number of the tree over the subroots; the trees of sources count from 0.
TOP = -1
KIDS = "array<struct<lo:bigint,hi:bigint,node:string>>"
PATH = "array<struct<left:string,right:string>>"


def digest(*values: Column) -> Column:
    return F.sha2(F.concat(*values).cast("binary"), 256)


def leaf_digest(text: Column) -> Column:
    """Leaf of a row whose text is ``text``; the other fields are taken by name."""
    values = [text if c == "text" else F.col(c).cast("string") for c in FIELDS]
    return digest(*(
        F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in values
    ))


def ranked(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``rank`` (from 0) among the rows of equal ``keys`` and their number, ``total``.

    ``order`` must tell all rows of a key apart. Numbers are places inside range partitions, so no key passes one task.
    """
    placed = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    placed = materialize(placed.withColumn("_at", F.monotonically_increasing_id()), "placed")
    held = placed.groupBy(*keys, F.shiftright("_at", 33).alias("_part")).agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    held = materialize(held, "held")  # at most as many rows as partitions and keys together
    before, later = held.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_part").alias("_p"), F.col("_rows").alias("_r")), held
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    # a key's rows stand in neighbouring partitions: only keys that several partitions hold have anything before
    shared = held.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    later = later.join(shared, reduce(Column.__and__, [later[k].eqNullSafe(shared[k]) for k in keys], F.lit(True)), "left_semi")
    sums = later.join(before, reduce(Column.__and__, [*same, F.col("_p") < F.col("_part")])).groupBy(*keys, "_part").agg(F.sum("_r").alias("_before"))
    starts = sums.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_part").alias("_p"), "_before")
    starts = held.join(starts, reduce(Column.__and__, [*same, F.col("_p") == F.col("_part")]), "left").select(
        *keys, "_part", (F.coalesce("_before", F.lit(0)) - F.col("_first")).alias("_shift")
    )
    totals = held.groupBy(*keys).agg(F.sum("_rows").alias("total")).withColumnsRenamed({k: f"_{k}" for k in keys})
    starts = starts.join(totals, reduce(Column.__and__, same)).select(
        *(F.col(k).alias(f"_{k}") for k in keys), F.col("_part").alias("_p"), "_shift", "total"
    )
    met = placed.join(starts, reduce(Column.__and__, [*same, F.shiftright("_at", 33) == F.col("_p")]))
    return met.select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("rank"), "total")


def _bucket(level: int, at: str = "lo") -> Column:
    """Number of the node of ``level`` that covers rank ``at``."""
    return F.shiftright(at, 4 * level)


def _is_top(level: int) -> Column:
    """Whether a node of ``level`` is its tree's last, by the number of the tree's leaves."""
    return F.col("total") <= WIDTH**level


def levels(leaves: DataFrame, name: str) -> list[DataFrame]:
    """Written tables (tree, total, lo, hi, node, kids) of levels 1, 2, ... over ``leaves`` (tree, total, lo, hi, node).

    ``kids`` are the children in order, (lo, hi, node). A tree of ``total`` leaves stops at the level where it has one node.
    """
    out, below, level = [], leaves, 0
    largest = leaves.agg(F.max("total")).first()[0] or 0
    while WIDTH**level < largest:
        level += 1
        made = (
            below.filter(~_is_top(level - 1)).groupBy("tree", _bucket(level).alias("bucket"))
            .agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "node"))).alias("kids"), F.max("total").alias("total"))
            .select(
                "tree", "total", F.col("kids")[0]["lo"].alias("lo"), F.array_max("kids.hi").alias("hi"),
                digest(F.array_join("kids.node", "")).alias("node"), "kids",
            )
        )
        out.append(materialize(made, f"{name}-{level}"))
        below = out[-1].drop("kids")
    return out


def _step(kids: Column, lo: Column, hi: Column) -> Column:
    """The siblings left and right of the child whose interval holds [lo, hi)."""
    return F.struct(
        F.array_join(F.transform(F.filter(kids, lambda k: k["hi"] <= lo), lambda k: k["node"]), "").alias("left"),
        F.array_join(F.transform(F.filter(kids, lambda k: k["lo"] >= hi), lambda k: k["node"]), "").alias("right"),
    )


def with_paths(nodes: DataFrame, above: list[DataFrame], upper: DataFrame) -> DataFrame:
    """``nodes`` (tree, lo, hi, ...) with the columns of ``upper``, ``path`` grown by the steps from each node to its tree's top.

    ``above`` are the levels over the nodes; ``upper`` (tree, level, lo, hi, path, ...) is a row for each tree's top node.
    """
    carried = [c for c in upper.columns if c not in ("tree", "level", "lo", "hi")]
    found = None
    for level in range(len(above), -1, -1):
        mine = above[level - 1] if level else nodes
        # a tree's top node has its own steps to bring, as if from a parent without other children
        parents = upper.filter(F.col("level") == level).withColumn("kids", F.lit(None).cast(KIDS))
        if found is not None:
            parents = parents.unionByName(found, allowMissingColumns=True)
        parents = parents.select(
            F.col("tree").alias("_tree"), _bucket(level + 1).alias("_bucket"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"),
            F.col("kids").alias("_kids"), *carried,
        )
        inside = (
            (F.col("tree") == F.col("_tree")) & (_bucket(level + 1) == F.col("_bucket"))
            & (F.col("_lo") <= F.col("lo")) & (F.col("hi") <= F.col("_hi"))
        )
        step = F.when(F.col("_kids").isNull(), F.array().cast(PATH)).otherwise(F.array(_step(F.col("_kids"), F.col("lo"), F.col("hi"))))
        found = mine.join(parents, inside).withColumn("path", F.concat(step, "path")).drop("_tree", "_bucket", "_lo", "_hi", "_kids")
    return found


def folded(start: Column, path: Column) -> Column:
    """The root that ``start`` and the siblings of ``path`` give."""
    return F.aggregate(path, start, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]).cast("binary"), 256))


def tops(leaves: DataFrame, above: list[DataFrame]) -> DataFrame:
    """(tree, level, lo, hi, node): the last node of each tree."""
    found = []
    for level, made in enumerate([leaves, *above]):
        last = made.filter(_is_top(level) & ~_is_top(level - 1)) if level else made.filter(_is_top(0))
        found.append(last.select("tree", F.lit(level).alias("level"), "lo", "hi", "node"))
    return reduce(DataFrame.unionByName, found)


def manifest(docs: DataFrame, tampered_text: Column | None = None) -> DataFrame:
    """One row per document: doc_id, source, rank, leaf, subroot, root, path, proof_sha256, folded_root, verified.

    ``tampered_text``, where not null, is the text that a row is checked with in place of its own.
    """
    other = F.lit(None).cast("string") if tampered_text is None else tampered_text
    rows = docs.select(
        "doc_id", "source", leaf_digest(F.col("text")).alias("leaf"), F.when(other.isNotNull(), leaf_digest(other)).alias("other"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = ranked(materialize(rows, "leaves"), ["source"], ["doc_id", "leaf", "row"])
    sources = materialize(rows.filter("rank = 0").select("source"), "sources")
    numbered = ranked(sources.withColumn("one", F.lit(0)), ["one"], ["source"])
    numbered = numbered.select(F.col("source").alias("_source"), F.col("rank").alias("tree"))
    leaves = rows.join(numbered, F.col("source").eqNullSafe(F.col("_source"))).select(
        "tree", "total", F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), F.col("leaf").alias("node"),
        "doc_id", "source", "other",
    )
    leaves = materialize(leaves, "ranked-leaves")
    bare = leaves.select("tree", "total", "lo", "hi", "node")
    above = levels(bare, "level")
    ends = materialize(tops(bare, above), "tops")
    subroots = ends.select(
        F.lit(TOP).cast("long").alias("tree"), F.lit(sources.count()).alias("total"), F.col("tree").alias("lo"), (F.col("tree") + 1).alias("hi"), "node"
    )
    higher = levels(subroots, "top-level")
    root = tops(subroots, higher).withColumns({"root": F.col("node"), "path": F.array().cast(PATH)}).drop("node")
    upper = with_paths(subroots, higher, root).select(F.col("lo").alias("tree"), F.col("node").alias("subroot"), "root", "path")
    upper = materialize(ends.drop("node").join(upper, "tree"), "upper-paths")
    found = with_paths(leaves, above, upper)
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    found = found.withColumn("folded_root", folded(F.coalesce("other", "node"), F.col("path")))
    return found.select(
        "doc_id", "source", F.col("lo").alias("rank"), F.col("node").alias("leaf"), "subroot", "root", "path",
        digest(siblings).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op13(docs: DataFrame) -> DataFrame:
    """Rows of the query; where 5 divides crc32 of the decimal doc_id, the text is checked with its A-Z lower-cased."""
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.translate("text", UPPER, LOWER))
    made = manifest(docs, tampered)
    return made.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
