"""Skill tagging of the documents with phrases of the benchmark texts as dictionary."""

from __future__ import annotations

from pyspark.sql import functions as F

from talentgrid.functions import text as tx
from talentgrid.operators import extraction as ex
from talentgrid.operators.linking import concept_labels
from talentgrid.plans.registry import query

LATIN = "abcdefghijklmnopqrstuvwxyz"
DEVANAGARI = "".join("\u0931" if c == "n" else chr(0x0915 + i) for i, c in enumerate(LATIN))


def _dictionary(b):
    phrases = b.raw("benchmark").select("item_id", F.explode(tx.candidate_phrases(F.col("text"))).alias("phrase"))
    return phrases.groupBy(tx.dictionary_key(F.col("phrase")).alias("key")).agg(F.concat(F.lit("b"), F.min("item_id").cast("string")).alias("uri"))


@query("ER-14")
def document_dictionary_tags(b):
    return ex.tag_documents(b.raw("documents").select("doc_id", "text"), _dictionary(b)).select("doc_id", "pos", "n", "span", "uri")


@query("ER-15")
def loanword_spans(b):
    """Foreign words of non-English chats that the lexicon, here one word per benchmark key, names."""
    lexicon = _dictionary(b).select(F.col("key").alias("term"), F.col("uri").alias("english"))
    phrases = b.raw("conversations").select(
        F.concat_ws(":", "conv_id", "turn").alias("chat"), F.posexplode(tx.candidate_phrases(F.lower("text"))).alias("i", "phrase"))
    phrases = phrases.select(F.concat_ws(":", "chat", "i").alias("phrase_id"), "phrase")
    hits, rest = ex.split_loanwords(phrases, lexicon)
    return rest.join(hits.groupBy("phrase_id").agg(F.count(F.lit(1)).alias("hits")), "phrase_id", "left").select(
        "phrase_id", F.coalesce("hits", F.lit(0)).alias("hits"), F.length("residual").alias("residual_length"))


@query("ER-16, SET-4")
def extracted_document_skills(b):
    dictionary = _dictionary(b)
    labels = concept_labels(dictionary.select("uri", F.col("key").alias("preferred"), F.array().cast("array<string>").alias("alternates")))
    # Spanish texts stand in for native-script ones: their letters become Devanagari ones, with marks apart from letters in
    # the texts and joined to them in the lexicon.
    lexicon = dictionary.select(F.translate("key", LATIN, DEVANAGARI).alias("term"), F.col("key").alias("english"))
    native = F.replace(F.translate(F.lower("text"), LATIN, DEVANAGARI), F.lit("\u0931"), F.lit("\u0930\u093c"))
    texts = b.raw("documents").select("doc_id", F.when(F.col("lang") == "es", native).otherwise(F.col("text")).alias("text"))
    skills, _ = ex.extract_skills(texts, dictionary, labels, lexicon, 0.75, 0.9)
    return skills.select("doc_id", "uri", F.round("score", 2).alias("score"), "method")


@query("SET-4", """
SELECT doc_id, array_to_string(list_concat(a, list_filter(b, lambda x: NOT list_contains(a, x))), '|') AS skills FROM (
  SELECT doc_id, [lang, source] AS a, [source, 'extra', lang] AS b0, ['extra'] AS b FROM documents)""")
def explicit_and_extracted(b):
    given, found = F.array("lang", "source"), F.array(F.col("source"), F.lit("extra"), F.col("lang"))
    return b.raw("documents").select("doc_id", F.array_join(ex.with_given_skills(given, found), "|").alias("skills"))
