"""Byte-level coding and prefix token counts against the public libraries."""

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from talentgrid.llm import bpe, tokens
from talentgrid.llm.pieces import units

RANKS, TABLE = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "b", " ", "  ", "\n", "\n\n", "'ll", "'s", "'", "é", "日", "🎉", "<|endoftext|>", "<|end", "12", "3", ".", "?!", "\t", "\xa0", "the", " of", "ing",
         "####", "\x00", "▁", "\r\n", "İ", "\x1c", "internationalisation"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    made = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    return list(enumerate([None, "", " ", *made, made[5], "=" * 3000, "word " * 30_000, "x" * 500]))


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(3, i, t, 1) for i, t in texts], "n_tokens int, doc_id long, text string, ids int")


def test_coding_is_that_of_the_library(docs, texts):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in bpe.encoded(docs, RANKS, public_tokenizers.PATTERN, decode=True).collect()}
    for i, t in texts:
        assert got[i].ids == library.encode_ordinary(t or "") and bytes(got[i].decoded).decode() == (t or "")
    again = bpe.encoded(docs, RANKS, public_tokenizers.PATTERN, keep=("n_tokens",)).select("doc_id", "n_tokens", bpe.decoded(F.col("ids"), RANKS).alias("d"))
    assert all(bytes(r.d).decode() == (dict(texts)[r.doc_id] or "") and r.n_tokens == 3 for r in again.collect())
    assert bpe.encoded(docs.filter("false"), RANKS, public_tokenizers.PATTERN).count() == 0


def test_counts_are_those_of_the_library_at_every_prefix(docs, texts):
    library = Tokenizer.from_file(TABLE)
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    counted = tokens.prefix_counts(docs, TABLE, public_tokenizers.PATTERN, budgets=(4, 1024))
    got = {r.doc_id: r for r in counted.collect()}
    counter = tokens.counter(TABLE, public_tokenizers.PATTERN)
    for i, t in texts:
        t = t or ""
        assert (got[i].n_bytes, got[i].n_chars, got[i].n_tokens) == (len(t.encode()), len(t), count(t))
        if len(t) < 200:
            every = [count(t[: k + 1]) for k in range(len(t))]
            assert counter.counts([t])[0].tolist() == every
            assert got[i].chars_within_4 == max((k + 1 for k, c in enumerate(every) if c <= 4), default=0)
    answers = counted.select("doc_id", tokens.tokens_at(F.col("steps"), F.lit(7)).alias("at"), tokens.chars_within(F.col("steps"), 1024).alias("within"),
                             "chars_within_1024")
    for r in answers.collect():
        assert r["at"] == count((dict(texts)[r.doc_id] or "")[:7]) and r.within == r.chars_within_1024
    assert tokens.prefix_counts(docs.filter("false"), TABLE, public_tokenizers.PATTERN).count() == 0


def test_units_join_to_the_text(texts):
    for _, t in texts:
        assert "".join(units(t or "")) == (t or "")


def test_queries_give_the_contract(spark):
    from talentgrid.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    rows = {r.doc_id: (r.text or "") for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in QUERIES["op5_byte_bpe"](spark, folder).collect():
        ids = library.encode_ordinary(rows[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(rows[r.doc_id].encode()).hexdigest()
    counts = Tokenizer.from_file(TABLE)
    for r in QUERIES["op7_token_counts"](spark, folder).collect():
        n = len(counts.encode(rows[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(rows[r.doc_id].encode()), n, n > 1024)


def test_a_piece_is_counted_once_however_it_is_marked():
    counter, asked = tokens.PrefixCounter(TABLE, public_tokenizers.PATTERN), []
    counted = counter.of_pieces
    counter.of_pieces = lambda pieces: asked.extend(pieces) or counted(pieces)
    for text in ("a word, a word. a (word", "the word; the word! a word\n \tword"):
        library = Tokenizer.from_file(TABLE)
        every = [len(library.encode(text[: k + 1], add_special_tokens=False).ids) for k in range(len(text))]
        assert counter.counts([text])[0].tolist() == every
    assert asked.count(" word") == 1 and len(asked) == len(set(asked))
