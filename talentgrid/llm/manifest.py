"""Merkle manifest of a table: a digest tree per source, a tree over the sources, and a checked proof for every row.

Rows are digested in place and numbered along ranges of (source, id), so only digests travel. A superblock holds
RUN ** levels successive nodes of one tree; one task reduces it to its top. Tops are nodes of the tree above and are
treated alike until every tree has one node. What a superblock needs from outside, the siblings of its top on the way to
the root, then comes back by a cogroup with the superblock's own nodes, where the lower levels are rebuilt, proofs joined
and folded. A hot source is many superblocks, and no list of nodes longer than one superblock meets in a task.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentgrid.session import cut

RUN = 16  # nodes whose digests make one node above
LEVELS = 3  # levels within a superblock, 4096 nodes

PATH = "path array<struct<before:string,after:string>>"


def _hash(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """`-` for null, else byte count, colon and value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def folded_case(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Rows with their place `pos` (from 0) in their tree by `order`, and the tree's `total`; no tree is sorted by one task."""
    ranged = cut(rows.repartitionByRange("tree", *order).withColumn("_range", F.spark_partition_id()))
    each = Window.partitionBy("tree")
    starts = ranged.groupBy("tree", "_range").agg(F.count(F.lit(1)).alias("_n")).select(
        "tree", "_range", F.sum("_n").over(each.orderBy("_range")).alias("_end"), "_n", F.sum("_n").over(each).alias("total"))
    here = F.row_number().over(Window.partitionBy("tree", "_range").orderBy(*order))
    return ranged.join(starts, ["tree", "_range"]).select(*rows.columns, (F.col("_end") - F.col("_n") + here - 1).alias("pos"), "total")


def _tree(nodes: list[str], total: int, levels: int) -> list[list[str]]:
    """The nodes of a superblock, then each level above them; a tree of `total` nodes ends when one is left."""
    made = [nodes]
    while len(made) <= levels and total > 1:
        made.append([_hash("".join(made[-1][i : i + RUN])) for i in range(0, len(made[-1]), RUN)])
        total = -(-total // RUN)
    return made


def _siblings(made: list[list[str]], place: int) -> list[tuple[str, str]]:
    """Digests before and after the node of one place in its run, level by level."""
    out = []
    for nodes in made[:-1]:
        start = place - place % RUN
        out.append(("".join(nodes[start:place]), "".join(nodes[place + 1 : start + RUN])))
        place //= RUN
    return out


def _block(levels: int) -> Column:
    return F.shiftright("pos", 4 * levels).alias("block")


def _outer(nodes: DataFrame, levels: int) -> DataFrame:
    """(tree, block, path, root) of every superblock of `nodes` (tree, pos, total, node): siblings of its top up to the root."""

    def top(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pos")
        tree, total = part["tree"].iloc[0], int(part["total"].iloc[0])
        return pd.DataFrame({
            "tree": [tree], "pos": [part["pos"].iloc[0] >> 4 * levels], "total": [-(-total // RUN**levels)],
            "node": [_tree(part["node"].tolist(), total, levels)[-1][0]]})

    tops = cut(nodes.select("tree", "pos", "total", "node", _block(levels)).groupBy("tree", "block").applyInPandas(
        lambda part: top(part), "tree string, pos long, total long, node string"))
    ended = tops.filter("total = 1").select(
        "tree", F.col("pos").alias("block"), F.array().cast(PATH.partition(" ")[2]).alias("path"), F.col("node").alias("root"))
    above = tops.filter("total > 1")
    if above.isEmpty():
        return ended
    return ended.unionByName(_paths(above, levels).withColumnRenamed("pos", "block"))


def _paths(nodes: DataFrame, levels: int) -> DataFrame:
    """(tree, pos, path, root) of every node: siblings before and after it on each level, and its tree's root."""

    def join(own: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("pos")
        made = _tree(own["node"].tolist(), int(own["total"].iloc[0]), levels)
        rest = [(s["before"], s["after"]) for s in outer["path"].iloc[0]]
        steps = [[{"before": b, "after": a} for b, a in _siblings(made, i) + rest] for i in range(len(own))]
        return pd.DataFrame({"tree": own["tree"], "pos": own["pos"], "path": steps, "root": outer["root"].iloc[0]})

    return cut(
        nodes.select("tree", "pos", "total", "node", _block(levels)).groupBy("tree", "block")
        .cogroup(_outer(nodes, levels).groupBy("tree", "block")).applyInPandas(join, f"tree string, pos long, {PATH}, root string"))


def manifest(
    docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), tampered: dict[str, Column] | None = None,
    tampered_where: Column | None = None, id_col: str = "doc_id", source_col: str = "source", levels: int = LEVELS,
) -> DataFrame:
    """One row per row of `docs`: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf digests `fields` of its row, nulls told apart from empty values. Leaves ascend by id within their source (rows
    without id first, rows that repeat an id by their digest); rows without source are a source of their own, the first
    one. `tampered` gives other expressions for some fields of the rows `tampered_where` holds for (null: it does not):
    their folded root starts at the digest of the changed row, and `verified` is false where it differs from the root.
    Rows alike in all fields get like leaves and proofs of their own. An empty table gives an empty result; columns that
    are no fields are not read, and names of columns may clash with those of the result.
    """
    kind = dict(docs.dtypes)[id_col]
    other = {f: (tampered or {}).get(f, F.col(f)) for f in fields}
    touched = F.coalesce(tampered_where, F.lit(False)) if tampered_where is not None else F.lit(False)
    leaf = lambda columns: F.sha2(F.concat(*columns), 256)
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("tree"), F.col(id_col).alias("id"),
        leaf([field(F.col(f)) for f in fields]).alias("node"),
        F.when(touched, leaf([field(c) for c in other.values()])).alias("changed"))
    leaves = cut(_numbered(rows, "id", "node").withColumn("id", F.col("id").cast("string")))
    outer = _outer(leaves, levels)
    subroots = outer.filter("block = 0").select(F.lit("").alias("tree"), F.col("tree").alias("source"), F.col("root").alias("node"))
    sources = cut(_numbered(subroots, "source"))
    above = _paths(sources.drop("source"), levels).join(sources.select("pos", "source"), "pos").select(
        F.col("source").alias("tree"), F.col("path").alias("above"), F.col("root").alias("top"))
    known = outer.join(above, "tree").select("tree", "block", F.concat("path", "above").alias("path"), F.col("root").alias("subroot"), "top")

    def prove(own: pd.DataFrame, outside: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("pos")
        nodes = own["node"].tolist()
        made = _tree(nodes, int(own["total"].iloc[0]), levels)
        rest = [(s["before"], s["after"]) for s in outside["path"].iloc[0]]
        beyond = "".join(b + a for b, a in rest)
        proofs, folded = [], []
        for place, (node, changed) in enumerate(zip(nodes, own["changed"], strict=True)):
            inside = _siblings(made, place)
            proofs.append(_hash("".join(b + a for b, a in inside) + beyond))
            now = node if changed is None else changed
            for before, after in inside + rest:
                now = _hash(before + now + after)
            folded.append(now)
        root = outside["top"].iloc[0]
        return pd.DataFrame({
            "doc_id": own["id"], "leaf": nodes, "subroot": outside["subroot"].iloc[0], "root": root, "proof_sha256": proofs,
            "folded_root": folded, "verified": [f == root for f in folded]})

    proven = leaves.select("tree", "pos", "total", "node", "id", "changed", _block(levels)).groupBy("tree", "block").cogroup(
        known.groupBy("tree", "block")).applyInPandas(
        prove, "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return proven.withColumn("doc_id", F.col("doc_id").cast(kind))
