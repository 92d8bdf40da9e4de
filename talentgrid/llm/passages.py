"""Passages that repeat across documents, by a sparse suffix array.

Of each document only the suffixes at minimiser positions are kept: in every run of WINDOW successive 25-word grams the
one with the smallest hash. Two copies of a passage of at least 50 words select the same positions inside it, so suffixes
whose gram occurs in one document only can be dropped at once. The others are sorted, after their gram, by the words to
the right and again by the words to the left; neighbours of different documents are compared and each match is extended
both ways. Suffixes with the same words around them, as copies have, collapse before the sort. What neighbours cannot see,
since each meets only the next, is found by digests of the runs of 50 words that two documents hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentgrid.session import broadcast_if_small, cut, release

LEAST_WORDS = 50
SLICE_ROWS = 256
SHARED_GRAMS = 1_000_000  # bound under which shared grams (8 bytes each) are broadcast
U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(32))


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, as they are written."""
    return (text or "").encode().split()


def _runs(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hashes of codes[start:end], by a polynomial whose powers and prefix sums wrap at 64 bits."""
    # A prefix is the sum of code * base ** place; times the inverse of base ** start (base is odd), runs are comparable.
    powers, inverse = (
        np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(len(codes), factor, np.uint64), dtype=np.uint64)])
        for factor in (base, pow(base, -1, 1 << 64)))
    sums = np.concatenate([[U(0)], np.cumsum(codes * powers[:-1], dtype=np.uint64)])
    return _mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * U(0xD1B54A32D192ED03))


def _chosen(codes: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each run of `window` grams the position of the smallest hash (the last of equal ones; it never falls), and all grams' hashes."""
    n = len(codes) - gram + 1
    if n < window:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    at = np.arange(n)
    hashes = _runs(codes, at, at + gram, 0x2545F4914F6CDD1D)
    least, place, width = hashes, at, 1
    while width < window:  # runs of `width` grams, two of which cover a longer one
        step = min(width, window - width)
        place = np.where(least[step:] <= least[:-step], place[step:], place[:-step])
        least = np.minimum(least[step:], least[:-step])
        width += step
    return place, hashes


def minimisers(codes: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the smallest gram hash in each run of `window` grams (the last of equal ones), and the hashes there."""
    of_run, hashes = _chosen(codes, gram, window)
    chosen = np.unique(of_run)
    return chosen, hashes[chosen]


def _around(codes: np.ndarray, pos: np.ndarray, window: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words before and from each position that a match through its gram can reach, and how many words those are."""
    low, high = np.maximum(pos - (window - 1), 0), np.minimum(pos + least, len(codes))
    return _runs(codes, low, pos, 0x5851F42D4C957F2D), _runs(codes, pos, high, 0x14057B7EF767814F), pos - low, high - pos


def _suffixes(docs: DataFrame, gram: int, window: int, least: int, around: bool = True) -> DataFrame:
    """gram, left, right (hashes of the gram and of the words around it), doc_id, pos, before, after (how many words those are).

    Without `around` only gram and doc_id.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(begin, SLICE_ROWS)
                known: dict[bytes, int] = {}
                split = ((row, words_of(text)) for row, text in enumerate(part.column(1).to_pylist()))
                numbered = [(row, [known.setdefault(w, len(known)) for w in words]) for row, words in split if len(words) >= least]
                hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in known), np.uint64, len(known))
                found = []
                for row, numbers in numbered:
                    codes = hashes[numbers]
                    pos, grams = minimisers(codes, gram, window)
                    if not around:
                        found.append((np.full(len(pos), row), grams))
                        continue
                    left, right, before, after = _around(codes, pos, window, least)
                    found.append((np.full(len(pos), row), grams, left, right, pos, before, after))
                if found and not around:
                    rows, grams = (np.concatenate(c) for c in zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), part.column(0).take(pa.array(rows))], ["gram", "doc_id"])
                elif found:
                    rows, grams, left, right, pos, before, after = (np.concatenate(c) for c in zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(grams.view(np.int64)), pa.array(left.view(np.int64)), pa.array(right.view(np.int64)), part.column(0).take(pa.array(rows)),
                         pa.array(pos.astype(np.int32)), pa.array(before.astype(np.int32)), pa.array(after.astype(np.int32))],
                        ["gram", "left", "right", "doc_id", "pos", "before", "after"])

    return docs.mapInArrow(
        find, f"gram long, left long, right long, doc_id {kind}, pos int, before int, after int" if around else f"gram long, doc_id {kind}")


def _placed(chosen: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, text and places of the documents that the suffixes of `chosen` are taken from."""
    wanted = chosen.groupBy("doc_id").agg(F.collect_list(F.struct("gram", "left", "right", "pos", "many")).alias("places"))
    return docs.join(broadcast_if_small(wanted, 50_000), "doc_id").select("doc_id", "text", "places")


def _in_both_orders(rows: DataFrame, gram: int, window: int, least: int) -> DataFrame:
    """Two rows per suffix of `rows`, as _placed gives them: `sorted` holds its words onward (side 0) or backward (side 1), `other` the others.

    `near` digests the first words of the order after the gram. A match of `least` words needs half of what is missing from
    the gram on one side, so in one of the orders both its suffixes have the same `near`.
    """
    kind, near = dict(rows.dtypes)["doc_id"], (least - gram + 1) // 2

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                words, made = words_of(batch.column("text")[row].as_py()), []
                for p in batch.column("places")[row].as_py():
                    onward, back = words[p["pos"] : p["pos"] + least], words[max(0, p["pos"] - window + 1) : p["pos"]][::-1]
                    texts = b" ".join(onward).decode(), b" ".join(back).decode()
                    for side, first in ((0, onward[gram : gram + near]), (1, back[:near])):
                        digest = xxhash.xxh3_64_intdigest(b" ".join(first)) - (1 << 63)
                        made.append((p["gram"], p["left"], p["right"], side, digest, texts[side], texts[1 - side], p["many"]))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([m[i] for m in made], k) for i, k in enumerate(kinds)), batch.column("doc_id").take(pa.array([row] * len(made), pa.int64()))],
                    ["gram", "left", "right", "side", "near", "sorted", "other", "many", "doc_id"])

    return rows.mapInArrow(
        read, f"gram long, left long, right long, side int, near long, sorted string, other string, many boolean, doc_id {kind}")


def _common(a: list[str], b: list[str]) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i in range(n) if a[i] != b[i])


def _neighbours(suffixes: DataFrame, least: int) -> DataFrame:
    """Matches (gram, left, right, before, after) of at least `least` words between suffixes that are neighbours in an order.

    Rows are dealt by gram, side and `near`. Of a run of one document's suffixes all meet the next other document's.
    """
    ready = suffixes.repartition("gram", "side", "near").sortWithinPartitions("gram", "side", "sorted", "doc_id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run: list[dict] = []  # the last suffixes of one document
        before_run: dict | None = None  # the last one of another document before them
        for batch in batches:
            found = []

            def meet(a: dict, b: dict, found: list = found) -> None:
                shared = _common(a["sorted"], b["sorted"]), _common(a["other"], b["other"])
                onward, back = shared[a["side"]], shared[1 - a["side"]]
                if onward + back >= least:
                    found.extend((x["gram"], x["left"], x["right"], back, onward) for x in (a, b))

            for now in batch.to_pylist():
                now["sorted"], now["other"] = now["sorted"].split(" ") if now["sorted"] else [], now["other"].split(" ") if now["other"] else []
                if run and (run[-1]["gram"], run[-1]["side"]) != (now["gram"], now["side"]):
                    run, before_run = [], None
                if run and (now["many"] or run[-1]["many"] or run[-1]["doc_id"] != now["doc_id"]):
                    for other in run:
                        meet(other, now)
                    before_run, run = run[-1], [now]
                else:
                    if before_run is not None:
                        meet(before_run, now)
                    run.append(now)
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[i] for f in found], kind) for i, kind in enumerate([pa.int64()] * 3 + [pa.int32()] * 2)], ["gram", "left", "right", "before", "after"])

    return ready.mapInArrow(compare, "gram long, left long, right long, before int, after int")


def _in_runs(rows: DataFrame, gram: int, window: int, least: int) -> tuple[DataFrame, DataFrame]:
    """Matches (gram, left, right, before, after) of suffixes of `rows` by the runs of `least` words that two documents hold; what they are read from.

    A run is digested at its own minimiser only, which all its copies share. Runs of one suffix all hold its gram, so they
    make one stretch. Suffixes of several documents match whole anyway and are only met here.
    """
    kind, around = dict(rows.dtypes)["doc_id"], ["gram", "left", "right"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(begin, SLICE_ROWS)
                known: dict[bytes, int] = {}
                numbered = [[known.setdefault(w, len(known)) for w in words_of(text)] for text in part.column("text").to_pylist()]
                hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in known), np.uint64, len(known))
                made = []
                for row, (numbers, places) in enumerate(zip(numbered, part.column("places").to_pylist(), strict=True)):
                    codes = hashes[numbers]
                    of_run, grams = _chosen(codes, gram, window)
                    places = [p for p in places if p["pos"] < len(grams)]  # rows that share an id may differ
                    if not places or not len(of_run):
                        continue
                    pos = np.array([p["pos"] for p in places])
                    left, right, _, _ = _around(codes, pos, window, least)
                    own = np.stack([grams[pos], left, right], axis=1).view(np.int64).tolist()
                    first, end = np.searchsorted(of_run, pos), np.searchsorted(of_run, pos, "right")
                    at = np.arange(len(of_run))
                    runs = _runs(codes, at, at + least, 0x369DEA0F31A53F85).view(np.int64)
                    made.extend(
                        (*own[i], int(pos[i] - first[i]), p["many"], runs[first[i] : end[i]], row)
                        for i, p in enumerate(places) if own[i] == [p["gram"], p["left"], p["right"]] and first[i] < end[i])
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([m[i] for m in made], k) for i, k in enumerate(kinds)), part.column("doc_id").take(pa.array([m[6] for m in made], pa.int64()))],
                    [*around, "back", "many", "runs", "doc_id"])

    held = cut(rows.mapInArrow(digest, f"gram long, left long, right long, back int, many boolean, runs array<long>, doc_id {kind}"))
    shared = held.select("gram", "many", "doc_id", F.explode("runs").alias("run")).groupBy("gram", "run").agg(
        F.min("doc_id").alias("one"), F.max("doc_id").alias("other"), F.max("many").alias("many"), F.min("many").alias("closed")).filter(
        "not closed and (many or one <> other)").select("gram", "run")
    before = F.col("back") - F.col("at")
    return held.filter("not many").select(*around, "back", F.posexplode("runs").alias("at", "run")).join(
        broadcast_if_small(shared, SHARED_GRAMS), ["gram", "run"]).groupBy(*around).agg(
        F.max(before).alias("before"), F.max(F.lit(least) - before).alias("after")), held


def repeated_passages(docs: DataFrame, least: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stretches of words that repeat in other documents: doc_id, start_word, end_word (exclusive), n_words, passage.

    A stretch is the union of overlapping matches of at least `least` words with other documents; `passage` joins its words
    with single spaces. Words stand between ASCII white space and are compared as written. Every match is found. Null,
    blank and shorter texts have no stretches; what repeats within one document alone is none, and rows that repeat an id
    are one document, rows without id none. An empty table gives an empty result; other columns are not read.
    """
    gram = least // 2
    window = least - gram + 1
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null")
    suffixes = _suffixes(rows, gram, window, least)
    shared = _suffixes(rows, gram, window, least, around=False).groupBy("gram").agg(F.min("doc_id").alias("one"), F.max("doc_id").alias("other")).filter("one <> other").select("gram")
    held = cut(suffixes.join(broadcast_if_small(shared, SHARED_GRAMS), "gram"))
    around = ["gram", "left", "right"]
    contexts = cut(
        held.groupBy(*around).agg(F.min(F.struct("doc_id", "pos", "before", "after")).alias("first"), F.max("doc_id").alias("other"))
        .select(*around, "first.*", (F.col("first.doc_id") != F.col("other")).alias("many")))
    open_grams = contexts.groupBy("gram").agg(F.min("many").alias("closed"), F.count(F.lit(1)).alias("n")).filter("not closed and n > 1").select("gram")
    open_ = _placed(contexts.join(cut(open_grams), "gram", "left_semi"), rows)
    by_runs, runs = _in_runs(open_, gram, window, least)
    met = _neighbours(_in_both_orders(open_, gram, window, least), least).unionByName(by_runs)
    whole = contexts.filter(F.col("many") & (F.col("before") + F.col("after") >= least)).select(*around, "before", "after")
    matches = cut(whole.unionByName(met).groupBy(*around).agg(F.collect_set(F.struct("before", "after")).alias("reach")))
    release(contexts, runs)
    spans = held.select(*around, "doc_id", "pos").join(matches, around).select(
        "doc_id", "pos", F.explode("reach").alias("r")).select(
        "doc_id", (F.col("pos") - F.col("r.before")).alias("start"), (F.col("pos") + F.col("r.after")).alias("end"))
    stretches = spans.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))
    texts = rows.join(broadcast_if_small(stretches, 50_000), "doc_id")
    kind = dict(rows.dtypes)["doc_id"]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                words, joined = words_of(batch.column("text")[row].as_py()), []
                for s in batch.column("spans")[row].as_py():
                    if joined and s["start"] < joined[-1][1]:
                        joined[-1][1] = max(joined[-1][1], s["end"])
                    else:
                        joined.append([s["start"], s["end"]])
                joined = [j for j in joined if j[1] <= len(words)]  # rows that share an id may differ in length
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array([row] * len(joined), pa.int64())), pa.array([j[0] for j in joined], pa.int64()),
                     pa.array([j[1] for j in joined], pa.int64()), pa.array([j[1] - j[0] for j in joined], pa.int64()),
                     pa.array([b" ".join(words[j[0] : j[1]]).decode() for j in joined], pa.string())],
                    ["doc_id", "start_word", "end_word", "n_words", "passage"])

    return texts.select("doc_id", "text", "spans").mapInArrow(merge, f"doc_id {kind}, start_word long, end_word long, n_words long, passage string")
