"""String and array expressions over posting fields, titles and free text."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Punctuation trimmed from both edges of a tag, and after a leading dot from the right edge only.
EDGE_PUNCTUATION = r"[\s\-_.,;:/|]+"
RIGHT_ONLY_PUNCTUATION = r"[ \-_,;:/|]+"

# Title abbreviations and their expansions, applied in this order.
TITLE_EXPANSIONS = [
    (r"\bai\s*/\s*ml\b|\baiml\b", "artificial intelligence machine learning"),
    (r"\bml\b", "machine learning"),
    (r"\bai\b", "artificial intelligence"),
    (r"\bhr\b", "human resources"),
    (r"\bqa\b", "quality assurance"),
    (r"\bui\s*/\s*ux\b|\bux\s*/\s*ui\b", "ui ux"),
    (r"\bbde\b", "business development executive"),
    (r"\bbdm\b", "business development manager"),
    (r"\bmis\b", "management information systems"),
    (r"\bsde\b", "software development engineer"),
    (r"\bdev\s*ops\b", "devops"),
]

# Seniority and hiring words removed from titles.
TITLE_NOISE = [
    "senior", "sr", "jr", "junior", "trainee", "fresher", "freshers", "intern", "urgent(?:ly)?", "hiring", "opening",
    "openings", "vacancy", "immediate(?:ly)?", "joiners?", r"walk[\s-]?in", "wfh", "work from home", "remote", "hybrid",
    "required", "l[1-5]", r"level\s*[1-5]", r"grade\s*[a-z0-9]+", "ii", "iii", "iv",
]

# Words that mark a location as remote work.
REMOTE_WORDS = ["remote", "work from home", "wfh", "anywhere in india", "pan india", "india"]

# Spellings folded together in skill lists.
SKILL_ALIASES = {
    "machine learning": "machine learning",
    "ml": "machine learning",
    "python programming": "python",
    "ms excel": "excel",
    "microsoft excel": "excel",
    "powerbi": "power bi",
    "statistics": "statistics",
    "statistical modeling": "statistical modelling",
}

# Role families and the first-match patterns that define them.
ROLE_FAMILIES = [
    ("Data architect", r"data\s*architect"),
    ("Data engineer", r"data\s*engineer|etl|big\s*data"),
    ("Data scientist", r"data\s*scientist|machine\s*learning|\bml\s*engineer"),
    ("Business analyst", r"business\s*analyst"),
    ("Data analyst", r"data\s*analyst|analytics|business intelligence|\bbi\b"),
    ("Software", r"developer|software|programmer"),
    ("Operations", r"operations|data entry|back office"),
]

# Romanised Hindi words used for language routing.
ROMAN_HINDI = [
    "hai", "hain", "karna", "karta", "karti", "aata", "aati", "mujhe", "mein", "aur", "kaam", "ka", "ki", "ke", "seekha",
    "jaanta", "jaanti", "sakta", "sakti", "chalana", "banana", "likhna", "bolna", "nahi",
]

# List punctuation and joining words that end a phrase.
PHRASE_BREAKS = r"[\n\r;,•·●▪◦|/।॥]+|\s+-\s+|(?<!\S)(?:और|ਅਤੇ|(?i:and|aur))(?!\S)"
PHRASE_EDGE = " .:()[]{}\"'।॥"

# Bracketed parts, unwanted characters, dotted ranks and edge characters of titles.
TITLE_BRACKETS = r"[\(\[][^\)\]]*[\)\]]"
TITLE_OTHER = r"[^a-z0-9+#/&\. ]+"
TITLE_RANKS = r"\b(?:sr|jr)\."
TITLE_EDGE = " -/.&"

# What separates places, marks hybrid work, and is cut from a place name.
PLACE_BREAKS = r"[,/;|]| and "
HYBRID_PREFIX = r"(?i)^\s*hybrid\s*[-:]\s*"
PLACE_BRACKETS = r"\([^)]*\)"

# Wording that marks clerical work-from-home offers; both must occur.
CLERICAL_WORDS = "data entry|typing"
EARNING_WORDS = "earn|present job|freelanc|home based"

# Letters of a script above which a text is in it, and the share of Hindi words that marks romanised Hindi.
SCRIPT_LETTERS = 5
ROMAN_SHARE = 0.15

# Words of a text for dictionary tagging (Latin with + # ., Devanagari, Gurmukhi).
TOKEN_PATTERN = r"([A-Za-z0-9+#.]+|[ऀ-ॿ]+|[਀-੿]+)"


def _escape_class(chars: str) -> str:
    return "".join("\\" + c if c in r"[]{}().^$*+?|\-" else c for c in chars)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it inside `body`; an outer expression in a lambda is otherwise redone per element."""
    return F.transform(F.array(value), lambda v: body(v))[0]


def strip_chars(c: Column, chars: str) -> Column:
    """Remove any of `chars` from both ends."""
    cls = f"[{_escape_class(chars)}]+"
    return F.regexp_replace(c, f"^{cls}|{cls}$", "")


def squeeze(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", " ")


def normal(c: Column) -> Column:
    """Lower-cased, trimmed, single-spaced text; null becomes ''."""
    return squeeze(strip_chars(F.lower(F.coalesce(c, F.lit(""))), " \t\n\r"))


def normalize_tag(c: Column) -> Column:
    def trimmed(t: Column) -> Column:
        both = F.regexp_replace(t, f"^{EDGE_PUNCTUATION}|{EDGE_PUNCTUATION}$", "")
        return F.when(t.startswith("."), F.regexp_replace(t, f"{RIGHT_ONLY_PUNCTUATION}$", "")).otherwise(both)

    return bind(squeeze(F.lower(strip_chars(c, " \t\n\r"))), trimmed)


def split_tags(c: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), ","), normalize_tag)
    return F.array_distinct(F.filter(parts, lambda t: (F.length(t) > 0) & (F.length(t) <= 80)))


def normalize_title(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^0-9a-z+#]+", " "))


def clean_title(c: Column) -> Column:
    t = F.regexp_replace(F.lower(c), TITLE_BRACKETS, " ")
    for pattern, text in TITLE_EXPANSIONS:
        t = F.regexp_replace(t, pattern, text)
    t = F.regexp_replace(t, TITLE_OTHER, " ")
    t = F.regexp_replace(t, r"\b(?:" + "|".join(TITLE_NOISE) + r")\b", " ")
    t = F.regexp_replace(t, TITLE_RANKS, " ")
    t = strip_chars(squeeze(t), TITLE_EDGE)
    return F.when(F.length(t) > 0, t).otherwise(F.lower(F.trim(c)))


def place_norm(c: Column) -> Column:
    """ASCII-folded place key: accents removed, other non-ASCII dropped, letters, digits, blanks and hyphens kept.

    Folding follows the compatibility decomposition of every character, so that full-width, ligature and twice-accented
    letters keep their base letters. Characters that fold to one are translated; the few that fold to several are looked
    up, in names that hold one.
    """
    single, several = _ascii_folds()
    folded = F.translate(c, "".join(single), "".join(single.values()))
    table = F.create_map(*[F.lit(x) for pair in several.items() for x in pair])
    spelled = F.array_join(F.transform(F.split(folded, ""), lambda ch: F.coalesce(F.try_element_at(table, ch), ch)), "")
    folded = F.when(folded.rlike("[" + "".join(several) + "]"), spelled).otherwise(folded)
    ascii_only = F.when(c.rlike(r"[^\x00-\x7F]"), F.regexp_replace(folded, r"[^\x00-\x7F]", "")).otherwise(c)
    return F.trim(squeeze(F.regexp_replace(F.lower(ascii_only), r"[^a-z0-9 \-]", " ")))


@cache
def _ascii_folds() -> tuple[dict[str, str], dict[str, str]]:
    """Characters whose compatibility decomposition has one, or several, ASCII characters."""
    folds = {}
    for point in [*range(0x80, 0xD800), *range(0xE000, 0x10000)]:
        base = unicodedata.normalize("NFKD", chr(point)).encode("ascii", "ignore").decode()
        if base:
            folds[chr(point)] = base
    return {c: b for c, b in folds.items() if len(b) == 1}, {c: b for c, b in folds.items() if len(b) > 1}


WORD_LETTERS = 62  # letters per word of match bits: the sum of two words and a carry stays below 64 bits


def _bits(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int")) - 1


def common_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two strings, by bit-parallel steps over words of letters of `a`.

    Bit i of the state is cleared once letter i ends a longer common subsequence; each letter of `b` takes an addition
    per word. Names of up to 62 letters fit in one word, longer ones hand carries on from word to word.
    """
    def single(x: Column, y: Column) -> Column:
        def places(letter: Column) -> Column:
            start = F.struct(F.lit(0).cast("long").alias("bits"), F.lit(1).cast("long").alias("bit"))
            return F.aggregate(x, start, lambda t, z: F.struct(
                (t["bits"] + F.when(z == letter, t["bit"]).otherwise(0)).alias("bits"), (t["bit"] * 2).alias("bit")))["bits"]

        def step(table: Column, full: Column, state: Column, letter: Column) -> Column:
            hit = state.bitwiseAND(F.coalesce(F.try_element_at(table, letter), F.lit(0)))
            return (state + hit).bitwiseOR(state - hit).bitwiseAND(full)

        def run(table: Column) -> Column:
            full = _bits(F.size(x))
            return F.size(x) - F.bit_count(F.aggregate(y, full, lambda state, letter: step(table, full, state, letter)))

        return bind(F.map_from_entries(F.transform(F.array_distinct(x), lambda z: F.struct(z, places(z)))), run)

    def several(x: Column, y: Column) -> Column:
        words = F.transform(F.sequence(F.lit(0), F.size(x) - 1, F.lit(WORD_LETTERS)), lambda at: F.slice(x, at + 1, F.lit(WORD_LETTERS)))

        def step(words: Column, state: Column, letter: Column) -> Column:
            def word(done: Column, i: Column) -> Column:
                bits = F.aggregate(
                    words[i], F.struct(F.lit(0).cast("long").alias("bits"), F.lit(1).cast("long").alias("bit")),
                    lambda t, z: F.struct((t["bits"] + F.when(z == letter, t["bit"]).otherwise(0)).alias("bits"), (t["bit"] * 2).alias("bit")))["bits"]
                hit = state[i].bitwiseAND(bits)
                total = state[i] + hit + done["carry"]
                after = total.bitwiseOR(state[i] - hit).bitwiseAND(_bits(F.size(words[i])))
                return F.struct(F.concat(done["words"], F.array(after)).alias("words"), F.shiftright(total, WORD_LETTERS).bitwiseAND(F.lit(1).cast("long")).alias("carry"))

            start = F.struct(F.array().cast("array<bigint>").alias("words"), F.lit(0).cast("long").alias("carry"))
            return F.aggregate(F.sequence(F.lit(0), F.size(words) - 1), start, word)["words"]

        def run(words: Column) -> Column:
            last = F.aggregate(y, F.transform(words, lambda w: _bits(F.size(w))), lambda state, letter: step(words, state, letter))
            return F.size(x) - F.aggregate(last, F.lit(0), lambda n, w: n + F.bit_count(w))

        return bind(words, run)

    def letters(c: Column) -> Column:
        return F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0))

    def both(x: Column, y: Column) -> Column:
        return F.when((F.size(x) == 0) | (F.size(y) == 0), 0).when(F.size(x) <= WORD_LETTERS, single(x, y)).otherwise(several(x, y))

    return bind(letters(a), lambda x: bind(letters(b), lambda y: both(x, y)))


# Source spellings of states, in lower case, with the name used everywhere else.
STATE_NAMES = {
    "andaman and nicobar islands": "Andaman and Nicobar",
    "andaman & n. island": "Andaman and Nicobar",
    "the dadra and nagar haveli and daman and diu": "Dadra and Nagar Haveli and Daman and Diu",
    "dadra & nagar haveli & daman & diu": "Dadra and Nagar Haveli and Daman and Diu",
    "jammu & kashmir": "Jammu and Kashmir",
    "jammu and kashmir": "Jammu and Kashmir",
}


def canonical_state(c: Column) -> Column:
    """A state's usual name: blanks collapsed, known spellings replaced whatever their case."""
    table = F.create_map(*[F.lit(x) for pair in STATE_NAMES.items() for x in pair])
    return bind(squeeze(strip_chars(c, " \t\n\r\f\x0b")), lambda n: F.coalesce(F.try_element_at(table, F.lower(n)), n))


def location_parts(c: Column) -> Column:
    """Array of (token, hybrid, remote) per non-empty part of a location string, in listed order."""
    parts = F.filter(
        F.transform(F.split(F.coalesce(c, F.lit("")), PLACE_BREAKS), lambda p: F.trim(p)), lambda p: F.length(p) > 0
    )

    def describe(part: Column) -> Column:
        hybrid = part.rlike(HYBRID_PREFIX)
        token = F.regexp_replace(part, HYBRID_PREFIX, "")
        token = strip_chars(F.regexp_replace(token, PLACE_BRACKETS, " "), " -")

        def flagged(t: Column, key: Column) -> Column:
            remote = key.isin(REMOTE_WORDS) | key.startswith("remote")
            return F.struct(t.alias("token"), hybrid.alias("hybrid"), remote.alias("remote"), key.alias("key"))

        return bind(token, lambda t: bind(place_norm(t), lambda key: flagged(t, key)))

    return F.transform(parts, describe)


def location_tokens(parts: Column) -> Column:
    kept = F.filter(parts, lambda p: (F.length(p["key"]) > 0) & ~p["remote"])
    return F.transform(kept, lambda p: p["token"])


def work_mode(parts: Column) -> Column:
    """Hybrid wins over remote, remote over onsite, whatever the order of the parts."""
    hybrid = F.exists(parts, lambda p: p["hybrid"])
    remote = F.exists(parts, lambda p: (F.length(p["key"]) > 0) & p["remote"])
    return F.when(hybrid, "hybrid").when(remote, "remote").otherwise("onsite")


def label_variants(preferred: Column, alternates: Column) -> Column:
    """Array of (label, kind) with kinds preferred, preferred_short and alt."""
    short = F.trim(F.regexp_replace(preferred, r"\s*\([^)]*\)\s*", " "))
    has_short = (F.length(short) > 0) & (F.lower(short) != F.lower(preferred))

    def variant(label: Column, kind: str, priority: int) -> Column:
        return F.struct(label.alias("label"), F.lit(kind).alias("kind"), F.lit(priority).alias("priority"))

    first = F.array(variant(preferred, "preferred", 0))
    shortened = F.filter(F.array(variant(short, "preferred_short", 1)), lambda _: has_short)
    others = F.transform(
        F.filter(F.coalesce(alternates, F.array().cast("array<string>")), lambda a: F.length(a) > 0),
        lambda a: variant(a, "alt", 2),
    )
    return F.concat(first, shortened, others)


def split_lines(c: Column) -> Column:
    """Non-blank trimmed lines of an alternate-labels cell."""
    return F.filter(
        F.transform(F.split(F.coalesce(c, F.lit("")), r"\r\n|\r|\n"), lambda line: F.trim(line)), lambda line: F.length(line) > 0
    )


def role_family(title: Column) -> Column:
    t = normal(title)
    family = F.lit("Other")
    for name, pattern in reversed(ROLE_FAMILIES):
        family = F.when(t.rlike(pattern), name).otherwise(family)
    return family


def skill_list(c: Column, conservative: bool = True) -> Column:
    """Sorted distinct skills of a delimited list; a truncated last item is dropped in the conservative view."""
    aliases = F.create_map(*[F.lit(x) for pair in SKILL_ALIASES.items() for x in pair])

    def listed(raw: Column) -> Column:
        parts = F.split(F.regexp_replace(raw, r"\.\.\.$", ""), "[,;|]")
        whole = bind(parts, lambda p: F.slice(p, F.lit(1), F.size(p) - 1)) if conservative else parts
        kept = F.when(raw.endswith("..."), whole).otherwise(parts)
        trimmed = F.filter(F.transform(kept, lambda t: F.trim(t)), lambda t: (F.length(t) > 0) & (t != "..."))
        return F.array_sort(F.array_distinct(F.transform(trimmed, lambda t: F.coalesce(F.try_element_at(aliases, t), t))))

    return bind(normal(c), listed)


def quality_flag(text: Column) -> Column:
    """Clerical wording together with work-from-home earning wording."""
    return text.rlike(CLERICAL_WORDS) & text.rlike(EARNING_WORDS)


def detect_language(c: Column) -> Column:
    devanagari = F.regexp_count(c, F.lit("[ऀ-ॿ]"))
    gurmukhi = F.regexp_count(c, F.lit("[਀-੿]"))
    words = F.regexp_extract_all(F.lower(c), F.lit("([a-z]+)"), F.lit(1))
    hindi = F.size(F.filter(words, lambda w: w.isin(ROMAN_HINDI)))
    romanised = (F.size(words) > 0) & (hindi > ROMAN_SHARE * F.size(words))
    return (
        F.when((gurmukhi > SCRIPT_LETTERS) & (gurmukhi >= devanagari), "pa")
        .when(devanagari > SCRIPT_LETTERS, "hi")
        .when(romanised, "hi-Latn")
        .otherwise("en")
    )


def composed(c: Column) -> Column:
    """Canonical composition (NFC), done by the Unicode library that Spark brings along; plain ASCII is returned as it is."""
    library = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(False))
    return F.when(c.rlike(r"[^\x00-\x7F]"), library).otherwise(c)


def words_of(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: F.length(w) > 0)


def trim_filler(phrase: Column, filler: list[str]) -> Column:
    """Drop filler words and bare numbers from both ends of a phrase, never from its middle."""

    def keeps(w: Column) -> Column:
        core = F.lower(strip_chars(w, PHRASE_EDGE))
        return ~(core.isin(filler) | core.rlike(r"^\d+$"))

    def between(words: Column) -> Column:
        kept = F.filter(F.transform(words, lambda w, i: F.when(keeps(w), i + 1)), lambda i: i.isNotNull())
        ends = bind(kept, lambda k: F.struct(F.array_min(k).alias("first"), F.array_max(k).alias("last")))
        return bind(ends, lambda e: F.array_join(F.slice(words, e["first"], e["last"] - e["first"] + 1), " "))

    return strip_chars(F.coalesce(bind(words_of(phrase), between), F.lit("")), PHRASE_EDGE)


def first_spellings(phrases: Column) -> Column:
    """Phrases in order, later ones that differ only by case removed."""
    keyed = F.transform(phrases, lambda p, i: F.struct(F.lower(p).alias("key"), i.alias("i"), p.alias("p")))
    firsts = bind(
        F.array_sort(keyed),
        lambda s: F.filter(s, lambda x, j: ~x["key"].eqNullSafe(F.get(s, j - 1)["key"])),
    )
    in_order = F.array_sort(F.transform(firsts, lambda x: F.struct(x["i"].alias("i"), x["p"].alias("p"))))
    return F.transform(in_order, lambda x: x["p"])


def candidate_phrases(c: Column, filler: list[str] | None = None) -> Column:
    """Phrases of 1-6 words and 2-60 characters, first spelling kept per lower-cased phrase, in text order."""
    chunks = F.transform(F.split(F.coalesce(c, F.lit("")), PHRASE_BREAKS), lambda p: strip_chars(squeeze(p), PHRASE_EDGE))
    if filler:
        chunks = F.transform(chunks, lambda p: trim_filler(p, filler))
    kept = F.filter(
        chunks, lambda p: F.length(p).between(2, 60) & F.size(words_of(p)).between(1, 6)
    )
    return first_spellings(kept)


def dictionary_key(c: Column) -> Column:
    """Lookup key of a label or phrase in the extraction dictionary."""
    return squeeze(strip_chars(F.lower(c), " .,;:-_()[]"))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(TOKEN_PATTERN), F.lit(1))


def trigram_vector(c: Column, dims: int = 256) -> Column:
    """L2-normalised hashed character-trigram counts of a text padded with blanks."""
    padded = F.concat(F.lit("  "), F.lower(c), F.lit("  "))
    slots = bind(
        padded,
        lambda p: F.transform(
            F.sequence(F.lit(1), F.length(p) - 2),
            lambda i: F.pmod(F.xxhash64(F.substring(p, i, F.lit(3))), F.lit(dims)).cast("int"),
        ),
    )

    def dense(s: Column) -> Column:
        # Only slots that occur are counted, without a lambda per trigram, and what lies between them is filled with zeros.
        def times(d: Column) -> Column:
            return (F.size(s) - F.size(F.array_remove(s, d))).cast("double")

        zeros = lambda n: F.array_repeat(F.lit(0.0).cast("float"), n)
        norm = F.sqrt(F.aggregate(s, F.lit(0.0), lambda total, x: total + times(x)))
        filled = bind(norm, lambda n: bind(F.sort_array(F.array_distinct(s)), lambda held: F.concat(
            F.flatten(F.transform(held, lambda d, i: F.concat(
                zeros(d - 1 - F.when(i == 0, F.lit(-1)).otherwise(F.get(held, i - 1))), F.array((times(d) / n).cast("float"))))),
            zeros(dims - 1 - F.array_max(held)))))
        return F.coalesce(filled, F.array_repeat(F.lit(None).cast("float"), dims))

    return bind(slots, dense)
