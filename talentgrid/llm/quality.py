"""Quality scores from compressed sizes under two zstandard dictionaries.

One dictionary is built from texts labelled good, one from texts labelled bad. A text is cut into blocks, so that what it
repeats cannot replace the dictionary, and each block is compressed under both; the normalised difference of the two
sizes, with their level and the text's length, goes through a logistic calibration fitted on labelled texts that built no
dictionary.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 6000  # of each label, for dictionaries and calibration; the only bound on what is learnt from
DICTIONARY_BYTES = 112_640
BLOCK_BYTES = 1024
LEVEL = 3
SMALL = 32  # bytes that frames and short texts weigh about


@dataclass(frozen=True)
class Model:
    """Dictionaries of the bad and the good label, and the calibration's weights; without weights, one score for all."""

    bad: bytes
    good: bytes
    centre: tuple[float, ...] = ()
    spread: tuple[float, ...] = ()
    weights: tuple[float, ...] = ()
    prior: float = 0.5

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not self.weights:
            return np.full(len(texts), self.prior)
        x = (_terms(sizes(texts, self.bad, self.good)) - self.centre) / self.spread
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ np.array(self.weights[1:]), -40, 40)))


def _blocks(text: str) -> list[bytes]:
    raw = text.encode()
    return [raw[i : i + BLOCK_BYTES] for i in range(0, len(raw), BLOCK_BYTES)]


@cache
def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    known = zstandard.ZstdCompressionDict(content)
    known.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False)


def sizes(texts: list[str | None], bad: bytes, good: bytes) -> np.ndarray:
    """Bytes of each text, and its compressed bytes under both dictionaries; null counts as empty."""
    by_bad, by_good = _compressor(bad).compress, _compressor(good).compress
    cut = [_blocks(t or "") for t in texts]
    return np.array([[sum(map(len, b)), sum(len(by_bad(x)) for x in b), sum(len(by_good(x)) for x in b)] for b in cut], float).reshape(-1, 3)


def _terms(found: np.ndarray) -> np.ndarray:
    raw, bad, good = found.T
    diff, level, short = (bad - good) / (raw + SMALL), (bad + good) / 2 / (raw + SMALL), SMALL / (raw + SMALL)
    return np.stack([diff, level, short, diff * diff, level * level, short * short, diff * level, diff * short, level * short], 1)


def _dictionary(texts: list[str]) -> bytes:
    """A trained dictionary; of too few samples to train on, their last bytes."""
    blocks = [b for t in texts for b in _blocks(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, blocks, k=256, d=8, split_point=1.0, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[-DICTIONARY_BYTES:]


def fit(docs: DataFrame, labels: DataFrame, fold: Column | None = None, sample: int = SAMPLE_ROWS, id_col: str = "doc_id",
        text_col: str = "text", label_col: str = "quality") -> Model:
    """A model of labels 1 (good) and 0 (bad), from at most `sample` labelled documents of each, in hash order of the id.

    `fold`, a condition over the id column of `labels`, limits what may be learnt. Rows without id or label and labels of
    unknown documents teach nothing. Of one label alone, or of no labelled text, nothing can be learnt: every score is
    then the share of label 1 with one row of each added.
    """
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
    known = (known if fold is None else known.filter(fold)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
    order = F.sha2(F.col("_id").cast("string"), 256)
    picks = [known.filter(F.col("_label") == q).orderBy(order, "_id").limit(sample) for q in (0, 1)]
    few = F.broadcast(picks[0].unionByName(picks[1]))  # at most twice `sample` rows
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).join(few, "_id")
    found = sorted((r["_label"], r["_turn"], r["_text"]) for r in rows.select("_label", "_text", order.alias("_turn")).collect())
    by = {q: [t for label, _, t in found if label == q] for q in (0, 1)}
    prior = (len(by[1]) + 1) / (len(found) + 2)
    build = {q: [t for t in own[::2] if t] for q, own in by.items()}
    test = [(t, q) for q, own in by.items() for t in own[1::2]]
    if not (build[0] and build[1] and len({q for _, q in test}) == 2):
        return Model(b"", b"", prior=prior)
    bad, good = _dictionary(build[0]), _dictionary(build[1])
    terms, y = _terms(sizes([t for t, _ in test], bad, good)), np.array([q for _, q in test], float)
    centre, spread = terms.mean(0), terms.std(0) + 1e-9
    x = np.column_stack([np.ones(len(y)), (terms - centre) / spread])
    shrink, w = np.diag([0.0] + [0.5] * terms.shape[1]), np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + shrink, x.T @ (y - p) - shrink @ w)
    return Model(bad, good, tuple(centre.tolist()), tuple(spread.tolist()), tuple(w.tolist()), prior)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, score (0 to 1, the higher the likelier good).

    Only the text decides: a null text is scored as an empty one, repeated rows get equal scores, an empty table gives an
    empty result, and other columns are not read.
    """
    kind = dict(docs.dtypes)[id_col]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.scores(part.column(1).to_pylist()))], ["doc_id", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(score, f"doc_id {kind}, score double")


def with_scores(docs: DataFrame, model: Model, name: str, text_col: str = "text") -> DataFrame:
    """`docs` with the score of each row in column `name`, which must be new."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(model.scores(texts.to_pylist()))

    return docs.withColumn(name, score(F.col(text_col)))
