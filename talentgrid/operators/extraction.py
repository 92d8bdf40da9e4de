"""Dictionary tagging and skill extraction over a corpus of documents."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentgrid.functions import text as tx
from talentgrid.functions.distributed import pick_one
from talentgrid.operators.linking import hashed_vectors, link
from talentgrid.session import broadcast_if_small, cut

MAX_WORDS = 6
LOANWORD_WORDS = 3

# One-letter names that are skills.
SHORT_NAMES = ["c", "r"]

# Filler words trimmed from phrase edges in Hindi, Punjabi and romanised Hindi.
FILLER = [
    "मुझे", "मैं", "मैंने", "मेरा", "मेरी", "मेरे", "हम", "को", "का", "की", "के", "में", "से", "पर", "या", "भी", "है", "हैं", "हूँ",
    "हूं", "था", "थी", "थे", "आता", "आती", "आते", "जानता", "जानती", "सकता", "सकती", "कर", "करना", "करता", "करती", "किया",
    "थोड़ी", "थोड़ा", "बहुत", "अच्छा", "अच्छी", "अनुभव", "साल", "वर्ष", "काम", "बात", "ज्ञान", "जानकारी",
    "ਮੈਨੂੰ", "ਮੈਂ", "ਮੇਰਾ", "ਮੇਰੀ", "ਤੇ", "ਦਾ", "ਦੀ", "ਦੇ", "ਵਿੱਚ", "ਹੈ", "ਹਾਂ", "ਹਨ", "ਆਉਂਦਾ", "ਆਉਂਦੀ", "ਕਰ", "ਸਕਦਾ", "ਸਕਦੀ",
    "ਤਜਰਬਾ", "ਸਾਲ", "ਕੰਮ", "ਥੋੜ੍ਹੀ", "ਬਹੁਤ", "ਨੂੰ", "ਨਾਲ", "ਗੱਲ", "ਜਾਣਕਾਰੀ",
    *tx.ROMAN_HINDI, "thoda", "thodi", "bahut", "accha", "anubhav", "saal", "bhi", "se", "hoon", "hu", "main", "mera", "meri",
    "ko", "aate",
]


def kept_from_left(matches: Column) -> Column:
    """Matches, sorted by position and then length descending, that survive a left-to-right scan without overlaps."""
    start = F.struct(F.lit(0).alias("free"), F.filter(matches, lambda _: F.lit(False)).alias("kept"))

    def step(state: Column, m: Column) -> Column:
        fits = m["pos"] >= state["free"]
        return F.struct(
            F.when(fits, m["pos"] + m["n"]).otherwise(state["free"]).alias("free"),
            F.when(fits, F.concat(state["kept"], F.array(m))).otherwise(state["kept"]).alias("kept"))

    return F.aggregate(matches, start, step)["kept"]


def longest_matches(
    rows: DataFrame, owner: str, words: Column, dictionary: DataFrame, max_words: int, key: Callable[[Column], Column],
    bar_short: bool = False,
) -> DataFrame:
    """Longest dictionary matches per owner, scanned left to right: (owner, pos, n, span, value).

    `dictionary(key, value)` holds single-blank keys of at most `max_words` words; `key` turns a word into its lookup form.
    Each word leaves its row with the next few words only. A position goes on when its word is an entry or its first two
    words start one, and only those positions build longer keys. Dictionaries of proven size are broadcast, so only real
    matches are shuffled. With `bar_short`, single words of at most two characters count only if they name a skill.
    """
    sized = dictionary.withColumn("_words", F.split("key", " "))
    one = broadcast_if_small(sized.filter(F.size("_words") == 1).select(F.col("key").alias("w1"), F.col("value").alias("v1")))
    longer = sized.filter(F.size("_words") > 1)
    starts = broadcast_if_small(longer.select(F.array_join(F.slice("_words", 1, 2), " ").alias("w2")).distinct().withColumn("opens", F.lit(True)))
    entries = broadcast_if_small(longer.select("key", "value", F.lit(True).alias("is_entry")))
    windows = rows.select(owner, F.posexplode(tx.bind(words, lambda w: F.transform(
        w, lambda _, i: F.slice(w, i + 1, F.lit(max_words))))).alias("pos", "window"))
    placed = windows.withColumn("w1", key(F.col("window")[0])).withColumn(
        "w2", F.concat_ws(" ", "w1", key(F.get("window", F.lit(1))))).join(one, "w1", "left").join(starts, "w2", "left").filter(
        F.col("v1").isNotNull() | F.col("opens")).select(owner, "pos", "window", "w1", "v1", "opens")
    usable = ~((F.length("w1") <= 2) & ~F.col("w1").isin(SHORT_NAMES)) if bar_short else F.lit(True)
    # One pass: single words carry their value, longer keys look theirs up.
    first = F.col("v1").isNotNull() & usable
    lengths = F.filter(F.sequence(F.lit(1), F.size("window")), lambda n: F.when(n == 1, first).otherwise(F.coalesce("opens", F.lit(False))))
    grams = placed.select(owner, "pos", "window", "v1", F.explode(lengths).alias("n")).withColumn("gram", F.slice("window", F.lit(1), F.col("n")))
    looked = grams.withColumn("key", F.when(F.col("n") > 1, F.array_join(F.transform("gram", key), " "))).join(entries, "key", "left")
    hits = looked.filter((F.col("n") == 1) | F.col("is_entry")).select(
        owner, "pos", "n", F.array_join("gram", " ").alias("span"), F.when(F.col("n") == 1, F.col("v1")).otherwise(F.col("value")).alias("value")).groupBy(
        owner).agg(F.array_sort(F.collect_list(F.struct("pos", (-F.col("n")).alias("_order"), "n", "span", "value"))).alias("m"))
    return hits.select(owner, F.explode(kept_from_left(F.col("m"))).alias("z")).select(owner, "z.pos", "z.n", "z.span", "z.value")


def tag_documents(documents: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Dictionary skills found in whole texts: (doc_id, pos, n, span, uri); `documents(doc_id, text)`, `dictionary(key, uri)`."""
    found = longest_matches(
        documents, "doc_id", tx.tokens(F.col("text")), dictionary.select("key", F.col("uri").alias("value")), MAX_WORDS,
        lambda w: F.lower(w), bar_short=True)
    return found.withColumnRenamed("value", "uri")


def split_loanwords(phrases: DataFrame, lexicon: DataFrame, filler: Sequence[str] = FILLER) -> tuple[DataFrame, DataFrame]:
    """Transliterated terms of each phrase and what is left of it.

    `phrases(phrase_id, phrase)`, `lexicon(term, english)`. Returns (phrase_id, span, english) and (phrase_id, residual).
    Both sides are compared in canonical composition, so it does not matter how marks are put on letters.
    """
    words = tx.words_of(tx.composed(F.col("phrase")))
    terms = lexicon.select(tx.composed(F.trim("term")).alias("key"), F.trim("english").alias("value"))
    found = cut(longest_matches(
        phrases, "phrase_id", words, terms, LOANWORD_WORDS,
        lambda w: tx.strip_chars(w, tx.PHRASE_EDGE)))
    used = found.groupBy("phrase_id").agg(F.flatten(F.collect_list(
        F.sequence(F.col("pos"), F.col("pos") + F.col("n") - 1))).alias("used"))
    left = phrases.join(used, "phrase_id", "left").withColumn("used", F.coalesce("used", F.array().cast("array<int>")))
    rest = F.array_join(F.filter(words, lambda w, i: ~F.array_contains("used", i)), " ")
    return (found.select("phrase_id", "pos", tx.strip_chars(F.col("span"), tx.PHRASE_EDGE).alias("span"), F.col("value").alias("english")),
            left.select("phrase_id", tx.trim_filler(rest, list(filler)).alias("residual")))


def _redundant(phrase: Column, covered: Column) -> Column:
    """Inside a matched span, or a matched span plus at most one more word."""
    def outside(c: Column) -> Column:
        return F.size(tx.words_of(F.replace(phrase, c, F.lit(" ")))) <= 1

    return F.exists(covered, lambda c: F.contains(c, phrase)) | F.exists(
        covered, lambda c: (F.length(c) > 0) & F.contains(phrase, c) & outside(c))


def extract_skills(
    documents: DataFrame, dictionary: DataFrame, labels: DataFrame, lexicon: DataFrame, threshold: float,
    single_word: float | None = None, encoder: Callable[[Column], Column] | None = None,
    native_encoder: Callable[[Column], Column] | None = None, native_threshold: float | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Skills and unlinked phrases of every document.

    `documents(doc_id, text)`, `dictionary(key, uri)`, `labels` from `concept_labels`, `lexicon(term, english)`. Order of
    evidence: exact spans, transliterated terms, then vector links of phrases that add something new, and last those of
    phrases in a native script. The first evidence per (document, skill) wins.

    Of a text that is not English, what no term explains goes to the English encoder where it is all ASCII, and otherwise
    to `native_encoder`, which also encodes the labels it is compared with; from `native_threshold` (0.1 below the other
    one, 0.5 at least, unless given) it is accepted.
    """
    native_threshold = max(0.5, threshold - 0.1) if native_threshold is None else native_threshold
    # What several steps read is written out once, so that texts are read once for spans and once for phrases.
    dictionary = cut(dictionary)
    exact = cut(tag_documents(documents, dictionary))
    routed = documents.select("doc_id", "text", tx.detect_language(F.col("text")).alias("language"))
    phrases = cut(routed.select("doc_id", "language", F.posexplode(F.when(
        F.col("language") == "en", tx.candidate_phrases(F.col("text"))).otherwise(tx.candidate_phrases(F.col("text"), FILLER))).alias("pos", "phrase")))
    english = phrases.filter("language = 'en'").select("doc_id", "pos", "phrase")
    other = phrases.filter("language <> 'en'").select("doc_id", "pos", "phrase")
    other = other.withColumn("phrase_id", F.concat_ws(":", "doc_id", "pos"))
    hits, rest = split_loanwords(other.select("phrase_id", "phrase"), lexicon)
    terms = cut(hits.withColumn("key", tx.dictionary_key(F.col("english"))).join(dictionary, "key", "left").join(
        other.select("phrase_id", "doc_id", F.col("pos").alias("at")), "phrase_id"))
    leftover = cut(other.select("doc_id", "pos", "phrase_id").join(rest, "phrase_id").filter(F.length("residual") >= 2).select(
        "doc_id", "pos", F.col("residual").alias("phrase"), F.col("residual").alias("source")))
    native = leftover.filter(F.col("phrase").rlike(r"[^\x00-\x7F]"))
    leftover = leftover.filter(~F.col("phrase").rlike(r"[^\x00-\x7F]"))
    unknown = terms.filter(F.col("uri").isNull()).select(
        "doc_id", F.col("at").alias("pos"), F.col("english").alias("phrase"), F.concat("span", F.lit(" ("), "english", F.lit(")")).alias("source"))
    open_phrases = english.select("doc_id", "pos", "phrase", F.col("phrase").alias("source")).unionByName(leftover).unionByName(unknown)
    spans = exact.select("doc_id", "span").unionByName(terms.filter(F.col("uri").isNotNull()).select("doc_id", "span"))
    covered = spans.groupBy("doc_id").agg(F.collect_set(tx.dictionary_key(F.col("span"))).alias("covered"))
    keyed = open_phrases.withColumn("key", tx.dictionary_key(F.col("phrase"))).join(dictionary.select("key"), "key", "left_anti").join(
        covered, "doc_id", "left")
    fresh = cut(keyed.filter(F.col("covered").isNull() | ~_redundant(F.col("key"), F.col("covered"))).select("doc_id", "pos", "phrase", "source"))
    named = cut(labels.withColumn("label_id", F.xxhash64("uri", "kind", "label")).dropDuplicates(["label_id"]))

    def linked(phrases: DataFrame, encoder: Callable[[Column], Column] | None, threshold: float, single_word: float | None, stage: int) -> DataFrame:
        vectors = hashed_vectors(named.select("label_id", "uri", F.col("label").alias("text")), encoder).drop("text")
        # Phrases are short beside the work that each makes, so their tasks are not merged by size.
        tasks = int(phrases.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        texts = hashed_vectors(phrases.select(F.col("phrase").alias("text")).repartition(tasks, "text").distinct(), encoder)
        found = link(texts, named, vectors, threshold, single_word, 1).select(F.col("text").alias("phrase"), "uri", "score", "method", "accepted")
        return phrases.join(found, "phrase").withColumn("stage", F.lit(stage))

    matched = linked(fresh, encoder, threshold, single_word, 2).unionByName(
        linked(native.select("doc_id", "pos", "phrase", "source"), native_encoder or encoder, native_threshold, None, 3))
    every = (
        exact.select("doc_id", "uri", F.lit(1.0).alias("score"), F.lit("exact").alias("method"), F.col("span").alias("source"), F.lit(0).alias("stage"), "pos")
        .unionByName(terms.filter(F.col("uri").isNotNull()).select(
            "doc_id", "uri", F.lit(1.0).alias("score"), F.lit("transliteration").alias("method"), F.col("span").alias("source"), F.lit(1).alias("stage"), F.col("at").alias("pos")))
        .unionByName(matched.filter("accepted").select("doc_id", "uri", "score", "method", "source", "stage", "pos"))
    )
    skills = pick_one(every, ["doc_id", "uri"], [F.asc("stage"), F.asc("pos"), F.asc("source")])
    return skills.select("doc_id", "uri", "score", "method", "source"), matched.filter("NOT accepted").select("doc_id", F.col("source").alias("phrase"))


def with_given_skills(given: Column, extracted: Column) -> Column:
    """Explicit skills first, then extracted ones not already listed."""
    return F.array_union(given, extracted)
