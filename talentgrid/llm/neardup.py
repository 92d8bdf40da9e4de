"""Near-duplicate documents by HyperMinHash sketches.

A document's set of word shingles is hashed into buckets; of each bucket's smallest value a register keeps the number of
leading zeros and some bits after them. Bands of registers, empty ones filled from others, select candidates; the
collision-corrected estimate from the registers discards hopeless ones; links are confirmed on the full sets.

Documents of equal sets collapse first. In each band bucket every document meets the one that shares most with others; buckets whose members
then belong to several components meet once more across those components, so no pair that shares a band is left out and
a group of n near copies costs about n confirmations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentgrid.llm.links import components
from talentgrid.session import broadcast_if_small, cut

BANDS, ROWS = 40, 5  # of a pair with similarity 0.8, one in seven million shares no band
REGISTERS = BANDS * ROWS
MANTISSA = 10
DEVIATIONS = 5  # an estimate this many standard deviations under the threshold is hopeless
MAP_BITS = 2048  # of the map that bounds how much two sets can share
SLICE_ROWS = 256
U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A fixed scrambling of 64-bit numbers."""
    x = (x ^ (x >> U(31))) * U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(32))


PROBES = np.argsort(_mix(np.arange(1, REGISTERS * REGISTERS + 1, dtype=np.uint64)).reshape(REGISTERS, REGISTERS), axis=1)


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return (text or "").encode().lower().split()


def shingles_of(text: str | None, width: int) -> set[tuple[bytes, ...]]:
    """Distinct runs of `width` words; of fewer words the whole sequence, of none nothing."""
    words = words_of(text)
    if len(words) < width:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(width)), strict=False))


def hashed_shingles(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles."""
    codes: dict[bytes, int] = {}
    split = [[codes.setdefault(w, len(codes)) for w in words_of(t)] for t in texts]
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in codes), np.uint64, len(codes))
    out = []
    for own in split:
        h = hashes[own] if own else np.empty(0, np.uint64)
        if len(own) >= width:
            value = h[: len(h) - width + 1]
            for k in range(1, width):
                value = _mix(value) + h[k : len(h) - width + 1 + k]
            out.append(np.unique(_mix(value)))
        else:
            for k in range(1, len(h)):
                h = np.append(_mix(h[:1]) + h[1], h[2:])
            out.append(_mix(h[:1] + U(len(own))) if own else h)
    return out


def registers_of(hashes: np.ndarray) -> np.ndarray:
    """16-bit registers: 0 for an empty bucket, else leading zeros and mantissa of the smallest value, plus one."""
    out = np.zeros(REGISTERS, np.uint16)
    if len(hashes):
        bucket = ((hashes >> U(32)) * U(REGISTERS)) >> U(32)  # grows with the hash, so buckets are runs
        starts = np.flatnonzero(np.diff(bucket, prepend=U(REGISTERS)))
        least = np.minimum.reduceat(_mix(hashes ^ U(0x5851F42D4C957F2D)), starts) | U(1 << 11)
        zeros = 53 - np.frexp((least >> U(11)).astype(np.float64))[1].astype(np.int64)
        mantissa = (least << (zeros + 1).astype(np.uint64)) >> U(64 - MANTISSA)
        out[bucket[starts].astype(np.int64)] = zeros * (1 << MANTISSA) + mantissa.astype(np.int64) + 1
    return out


def bit_map(hashes: np.ndarray) -> np.ndarray:
    """MAP_BITS bits, of which each shingle sets one. A bit that only one of two sets has is a shingle that only it has."""
    bits = np.zeros(MAP_BITS, np.uint8)
    bits[(_mix(hashes ^ U(0xA0761D6478BD642F)) % U(MAP_BITS)).astype(np.int64)] = 1
    return np.packbits(bits)


def filled(registers: np.ndarray) -> np.ndarray:
    """Registers whose empty buckets repeat the first full one in an order of their own, equal for all documents."""
    out = registers.copy()
    empty = np.flatnonzero(out == 0)
    if 0 < len(empty) < REGISTERS:
        order = PROBES[empty]
        out[empty] = registers[order[np.arange(len(empty)), (registers[order] != 0).argmax(axis=1)]]
    return out


def band_keys(registers: np.ndarray) -> np.ndarray:
    """One 64-bit key per band and row of filled registers."""
    parts = registers.astype(np.uint64).reshape(len(registers), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(ROWS):
        key = _mix(key * U(0xD6E8FEB86659FD93) + parts[:, :, k])
    return key.view(np.int64)


def estimated(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Similarity of pairs of register rows, corrected for registers that agree by chance, and its standard deviation at 0.8."""
    either = np.maximum(((a != 0) | (b != 0)).sum(axis=1), 1)
    same = ((a == b) & (a != 0)).sum(axis=1)
    chance = np.zeros(len(a))
    for i in range(40):  # octaves of the smallest value; in one, mantissas of unequal sets agree once in 2 ** MANTISSA
        low, high = 1 - 2.0 ** -(i + 1), 1 - 2.0**-i
        chance += np.prod([low ** (n / REGISTERS) - high ** (n / REGISTERS) for n in (size_a, size_b)], axis=0) / (1 << MANTISSA)
    expected = chance * either
    return np.maximum(same - expected, 0) / np.maximum(either - expected, 1), np.sqrt(0.16 / either)


def sketches(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, mark (128-bit digest of the whole set), registers and bit map of each row of `docs`."""
    kind = dict(docs.dtypes)[id_col]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                sets = hashed_shingles(part.column(1).to_pylist(), width)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(map(len, sets), pa.int64()),
                     pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                     pa.array([registers_of(s).tobytes() for s in sets], pa.binary()), pa.array([bit_map(s).tobytes() for s in sets], pa.binary())],
                    ["doc_id", "n_shingles", "mark", "registers", "map"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        sketch, f"doc_id {kind}, n_shingles long, mark binary, registers binary, map binary")


def _with_bands(nodes: DataFrame) -> DataFrame:
    """`nodes` (node, size, registers, map) with band keys and the map as numbers."""
    kind = dict(nodes.dtypes)["node"]

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = np.stack([np.frombuffer(r, np.uint16) for r in batch.column(2).to_pylist()])
            full = np.stack([filled(r) for r in raw])
            lists = lambda rows: pa.ListArray.from_arrays(
                pa.array(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)), pa.array(rows.ravel()))
            maps = np.stack([np.frombuffer(m, np.int64) for m in batch.column(3).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], lists(band_keys(full)), lists(maps)], ["node", "size", "registers", "bands", "map"])

    return nodes.mapInArrow(band, f"node {kind}, size long, registers binary, bands array<long>, map array<long>")


def _plausible(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) whose estimated similarity is not hopeless."""
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("size").alias(f"size_{c}"), F.col("registers").alias(f"registers_{c}"))

    @F.pandas_udf("boolean")
    def hopeful(ra: pd.Series, rb: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
        a, b = (np.frombuffer(b"".join(r), np.uint16).reshape(-1, REGISTERS) for r in (ra, rb))
        about, deviation = estimated(a, b, na.to_numpy(float), nb.to_numpy(float))
        return pd.Series(about + DEVIATIONS * deviation >= similarity)

    large, small = F.greatest("size_a", "size_b"), F.least("size_a", "size_b")
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(small >= F.lit(similarity) * large).filter(
        hopeful("registers_a", "registers_b", "size_a", "size_b")).select("a", "b")


def _confirmed(pairs: DataFrame, docs: DataFrame, width: int, per_cent: int) -> DataFrame:
    """Pairs (a, b) whose full shingle sets are similar enough; `docs` has doc_id and text."""
    pairs = cut(pairs)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = cut(docs.join(broadcast_if_small(wanted), "doc_id", "left_semi"))
    kind = dict(docs.dtypes)["doc_id"]

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple[object, set] = (None, set())
        for batch in batches:
            good = []
            for b, text_b, text_a in zip(*(batch.column(c).to_pylist() for c in ("b", "text_b", "text_a")), strict=True):
                if known[0] != b:
                    known = (b, shingles_of(text_b, width))
                own = shingles_of(text_a, width)
                both = len(own & known[1])
                good.append(100 * both >= per_cent * (len(own) + len(known[1]) - both) and both > 0)
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    side = lambda c: texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}"))
    return cut(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(confirm, f"a {kind}, b {kind}"))


def _most_shared(left: str, right: str) -> Column:
    """A bound on how many shingles two sets share: neither has more than its size less its bits that the other lacks.

    `spare` is a set's size less its bits; words of the maps are taken one by one, which Spark compiles.
    """
    both = sum((F.bit_count(F.col(f"{left}.map")[j].bitwiseAND(F.col(f"{right}.map")[j])) for j in range(MAP_BITS // 64)), F.lit(0))
    return F.least(f"{left}.spare", f"{right}.spare") + both


def near_duplicates(docs: DataFrame, width: int = 5, per_cent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id (smallest id reachable over links), kept.

    Sets of `width`-word shingles are linked when 100 * shared >= `per_cent` * united. A null or blank text has an empty
    set and is linked with nothing, not even with another. Rows that repeat an id are one document whose links come from
    all of them; rows without id are never linked and have no component. An empty table gives an empty result; other
    columns of `docs` are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    similarity = per_cent / 100
    sketched = cut(sketches(rows, width, "doc_id", "text"))
    classes = (
        sketched.filter("n_shingles > 0 and doc_id is not null").groupBy("mark")
        .agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("size"), F.first("registers").alias("registers"), F.first("map").alias("map")))
    marks = cut(classes)
    nodes = cut(_with_bands(marks.select("node", "size", "registers", "map")))
    members = nodes.select("node", F.explode("bands").alias("key"))
    shared = cut(members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    held = cut(members.join(shared, "key"))
    # The one that shares most, as the original of edited copies does, is met by all others of a bucket.
    known = held.join(held.groupBy("node").agg(F.sum("n").alias("fame")), "node")
    leaders = cut(known.groupBy("key").agg(F.max_by("node", F.struct("fame", (-F.col("node")).alias("low"))).alias("leader")))
    star = cut(
        held.join(leaders, "key").filter("node <> leader")
        .select(F.greatest("node", "leader").alias("a"), F.least("node", "leader").alias("b")).distinct())
    links = _confirmed(_plausible(star, nodes, similarity), rows, width, per_cent)
    roots = components(links)

    # Buckets that hold several components: each member outside the largest one meets all members of the others.
    placed = held.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    mixed = cut(
        placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("key")
        .agg(F.max_by("root", F.struct("n", "root")).alias("major"), F.count(F.lit(1)).alias("roots")).filter("roots > 1").select("key", "major"))
    ones = F.aggregate("map", F.lit(0), lambda total, x: total + F.bit_count(x))
    apart = cut(placed.join(mixed, "key").join(nodes.select("node", "size", "map", (F.col("size") - ones).alias("spare")), "node"))
    left, right = apart.filter("root <> major").alias("l"), apart.alias("r")
    meets = (
        (F.col("l.key") == F.col("r.key")) & (F.col("l.root") != F.col("r.root"))
        & ((F.col("r.root") == F.col("r.major")) | (F.col("l.node") < F.col("r.node")))
        & (F.least("l.size", "r.size") >= F.lit(similarity) * F.greatest("l.size", "r.size")))
    meets = meets & ((100 + per_cent) * _most_shared("l", "r") >= per_cent * (F.col("l.size") + F.col("r.size")))
    across = left.join(right, meets).select(F.greatest("l.node", "r.node").alias("a"), F.least("l.node", "r.node").alias("b")).distinct()
    more = _confirmed(_plausible(across.join(star, ["a", "b"], "left_anti"), nodes, similarity), rows, width, per_cent)
    if not more.isEmpty():
        roots = components(links.unionByName(more))
    named = cut(marks.join(roots, "node", "left").select("mark", F.coalesce("root", "node").alias("root")))
    alone = F.col("n_shingles") == 0
    out = sketched.select("doc_id", "n_shingles", "mark").join(named, "mark", "left").withColumn(
        "component_id", F.when(alone | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("root")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
