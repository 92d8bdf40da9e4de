"""Native-script phrases: composed letters, routing, and an encoder and threshold of their own."""

import unicodedata

from pyspark.sql import functions as F

from talentgrid.functions import text as tx
from talentgrid.operators import extraction as ex
from talentgrid.operators.linking import concept_labels

NUKTA = "\u0921\u093c"  # a letter with its mark apart, as NFC keeps it
JOINED = "\u095c"
DECOMPOSED, COMPOSED = "\u0930\u093c", "\u0931"


def test_composition(spark):
    rows = ["", "plain", "e\u0301", "\u00e9", JOINED, NUKTA, DECOMPOSED, COMPOSED, "a\u0307\u0323", "a\u0323\u0307", "\u1100\u1161", "\ufb01", None]
    got = spark.createDataFrame([(r,) for r in rows], "c string").select("c", tx.composed(F.col("c")).alias("n")).collect()
    assert all(r.n == (None if r.c is None else unicodedata.normalize("NFC", r.c)) for r in got)


def test_marks_apart_match_terms_with_marks_joined(spark):
    lexicon = spark.createDataFrame([(f" {COMPOSED}क ", "rake"), (f"{JOINED}ख", "dakh")], "term string, english string")
    phrases = spark.createDataFrame([("a", f"{DECOMPOSED}क सही"), ("b", f"{NUKTA}ख")], "phrase_id string, phrase string")
    hits, rest = ex.split_loanwords(phrases, lexicon)
    assert {(r.phrase_id, r.english) for r in hits.collect()} == {("a", "rake"), ("b", "dakh")}
    assert {r.phrase_id: r.residual for r in rest.collect()} == {"a": "सही", "b": ""}


def test_native_phrases_have_their_own_encoder_and_threshold(spark):
    labels = concept_labels(spark.createDataFrame([("u1", "data analysis", []), ("u2", "welding", [])], "uri string, preferred string, alternates array<string>"))
    dictionary = spark.createDataFrame([("excel", "u9")], "key string, uri string")
    lexicon = spark.createDataFrame([("एक्सेल", "excel"), ("वेल्ड", "weldings")], "term string, english string")
    text = "मुझे एक्सेल और वेल्ड और विश्लेषण आँकड़े और data analysi आता है"
    docs = spark.createDataFrame([(1, text), (2, "excel, data analysi")], "doc_id long, text string")

    def native(c):  # says where a phrase in the script belongs, and gives labels the same axes
        known = F.when(c.contains("विश्लेषण") | (c == "data analysis"), F.array(F.lit(1.0), F.lit(0.0)))
        return known.otherwise(F.array(F.lit(0.3), F.lit(0.95)))

    def run(**more):
        skills, open_ = ex.extract_skills(docs, dictionary, labels, lexicon, 0.6, native_encoder=native, **more)
        return {(r.doc_id, r.uri, r.method) for r in skills.collect()}, {(r.doc_id, r.phrase) for r in open_.collect()}

    skills, _ = run()
    assert (1, "u9", "transliteration") in skills and (2, "u9", "exact") in skills and (2, "u1", "embedding") in skills
    assert (1, "u1", "embedding") in skills and (1, "u2", "embedding") in skills
    strict, unlinked = run(native_threshold=1.1)
    assert any("विश्लेषण" in p for _, p in unlinked) and (1, "u2", "embedding") in strict
