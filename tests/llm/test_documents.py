"""Exact, near and line de-duplication and repeated passages against brute force."""

from collections import Counter, defaultdict
import random
import re

import numpy as np
import pytest

from talentgrid.llm.links import components
from talentgrid.llm import lines, neardup, passages, radix

SCHEMA = "kept string, doc_id long, text string, component_id int"  # names that results use, too


def frame(spark, texts):
    return spark.createDataFrame([("x", i, t, 7) for i, t in texts], SCHEMA)


def closed(ids, links):
    """Smallest id reachable, of each id."""
    root = {i: i for i in ids}
    for _ in ids:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return root


def invented(rng, n, vocabulary=400):
    return [f"w{int(v)}" for v in rng.zipf(1.3, n) % vocabulary]


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(5)
    out = [None, "", " \n\t", "one", "One", "one two", "one  TWO", "two one", "İI ı"]
    for _ in range(25):
        base = invented(rng, int(rng.integers(12, 120)))
        out.append(" ".join(base))
        for _ in range(int(rng.integers(0, 5))):
            copy = list(base)
            for at in rng.integers(0, len(copy), int(rng.integers(0, 6))):
                copy[at] = f"z{int(rng.integers(0, 9))}"
            out.append(" ".join(copy))
    chain = invented(rng, 60)
    for k in range(12):  # neighbours are linked, ends are not
        out.append(" ".join(chain[:k] + [f"q{i}" for i in range(k)] + chain[k:]))
    out += ["lorem ipsum " * 4000, "lorem ipsum " * 3999, out[12], out[12]]
    return list(enumerate(out, start=3))


def test_exact_groups(spark):
    long = "ab cd " * 5000
    rows = [(5, "a b"), (3, "ab"), (9, " a\tb "), (4, None), (8, ""), (1, " "), (7, "a"), (2, long), (6, long.replace(" ", "\n\n")), (10, long + "x"),
            (11, "é" * 300), (12, "é" * 300 + "y"), (13, "é " * 300), (14, "ab\xa0"), (7, "a"), (15, "abcd" * 64), (16, "abcd" * 64 + "e"), (None, "zz"), (20, "z z")]
    got = radix.exact_groups(frame(spark, rows), first_digit=4, growth=2).collect()
    by = defaultdict(list)
    for i, t in rows:
        by[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    want = Counter()
    for members in by.values():
        best = min(members)
        for m in members:
            want[(m[3], best[3], len(members), m[3] == best[3] and m[0] == best[0])] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == want
    assert radix.exact_groups(frame(spark, [])).count() == 0


def test_near_duplicates(spark, texts):
    for width, per_cent in ((2, 80), (5, 80)):
        got = neardup.near_duplicates(frame(spark, texts), width, per_cent).collect()
        sets = {}
        for i, t in texts:
            words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
            sets[i] = {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()
        links = [(a, b) for a in sets for b in sets if a < b and sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= per_cent * len(sets[a] | sets[b])]
        root = closed(sets, links)
        assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == {(i, len(s), root[i], root[i] == i) for i, s in sets.items()}
        assert len(got) == len(texts)
    assert neardup.near_duplicates(frame(spark, [])).count() == 0


def test_rows_without_id_are_never_linked(spark):
    got = neardup.near_duplicates(frame(spark, [(None, "a b c d e f g"), (1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g")])).collect()
    assert Counter((r.doc_id, r.component_id, r.kept) for r in got) == Counter([(None, None, True), (1, 1, True), (1, 1, True), (2, 1, False)])


def test_register_estimate_is_close():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    a, b = np.unique(values[:2400]), np.unique(values[600:])
    rows = [np.stack([neardup.registers_of(x)]) for x in (a, b)]
    about, deviation = neardup.estimated(*rows, np.array([len(a)]), np.array([len(b)]))
    assert abs(about[0] - 1800 / 3000) < 4 * deviation[0]
    disjoint = neardup.estimated(rows[0], np.stack([neardup.registers_of(np.unique(rng.integers(0, 1 << 63, 2400).astype(np.uint64)))]), np.array([2400]), np.array([2400]))
    assert disjoint[0][0] < 0.02


def windows(line):
    return {line[i : i + 10] for i in range(max(1, len(line) - 9))}


def test_line_groups_and_texts(spark):
    rng = random.Random(3)
    pool = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 12))) for _ in range(rng.randint(1, 25))) for _ in range(30)]
    near = [p[:-1] + "x" for p in pool[:15]] + [p.replace("a", "b", 1) for p in pool[:20]]
    rows = [(i, "\n".join(rng.choice(pool + near) for _ in range(rng.randint(1, 6)))) for i in range(40)]
    rows += [(50, None), (51, ""), (52, "\n \n"), (53, "日本語の文章です。" * 3), (54, "日本語の文章です。" * 3 + "\n  " + pool[0] + "\t"), (55, "long words " * 3000 + pool[3])]
    got = lines.line_groups(frame(spark, rows)).collect()
    own = [(i, k, line.strip(" \t\n\x0b\f\r")) for i, t in rows if t is not None for k, line in enumerate(t.split("\n"))]
    sets = {line: windows(line) for _, _, line in own if line}
    names = sorted(sets)
    links = [(a, b) for n, a in enumerate(names) for b in names[n + 1 :] if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert links
    root = closed(names, links)
    groups = defaultdict(list)
    for i, k, line in own:
        groups[root[line] if line else (i, k)].append((i, k))
    want = {(i, k, *min(groups[root[line] if line else (i, k)]), len(groups[root[line] if line else (i, k)])) for i, k, line in own}
    assert {(r.doc_id, r.line_no, r.keep_doc_id, r.keep_line_no, r.copies) for r in got} == want
    assert all(r.kept == ((r.doc_id, r.line_no) == (r.keep_doc_id, r.keep_line_no)) for r in got)
    docs = frame(spark, rows + [(None, "a line without an id")])
    after = lines.without_similar_lines(docs)
    assert after.columns == docs.columns and after.count() == docs.count()
    left = {r.doc_id: r.text for r in after.collect()}
    stay = {(w[0], w[1]) for w in want if w[:2] == w[2:4]}
    for i, t in rows:
        assert left[i] == (None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) in stay))
    assert left[None] == "a line without an id"
    assert lines.line_groups(frame(spark, [])).count() == 0


def test_repeated_passages(spark):
    rng = np.random.default_rng(8)
    shared = [invented(rng, n, 10_000) for n in (50, 49, 63, 90, 200)]
    rows = [(0, None), (1, ""), (2, "short text"), (3, "and " * 300), (4, "and " * 120), (5, " ".join(shared[0]))]
    for i in range(6, 40):
        parts = [invented(rng, int(rng.integers(5, 60)), 10_000) for _ in range(3)]
        parts.insert(int(rng.integers(0, 3)), shared[int(rng.integers(0, 5))])
        rows.append((i, "  \n".join(" ".join(p) for p in parts)))
    rows += [(40, rows[10][1]), (41, " ".join(invented(rng, 80, 10_000) * 3)), (41, "other row of the same document")]
    got = passages.repeated_passages(frame(spark, rows)).collect()
    seen, want = defaultdict(set), defaultdict(set)
    split = [(i, (t or "").split()) for i, t in rows]
    for i, w in split:
        for p in range(len(w) - 49):
            seen[tuple(w[p : p + 50])].add(i)
    for i, w in split:
        for p in range(len(w) - 49):
            if len(seen[tuple(w[p : p + 50])]) > 1:
                want[i] |= set(range(p, p + 50))
    found = defaultdict(set)
    words = dict(split[:-1])
    for r in got:
        assert r.n_words == r.end_word - r.start_word >= 50 and r.passage == " ".join(words[r.doc_id][r.start_word : r.end_word])
        assert not found[r.doc_id] & set(range(r.start_word, r.end_word))
        found[r.doc_id] |= set(range(r.start_word, r.end_word))
    assert found == want and 41 not in want and {3, 4, 5, 40} <= set(want)
    assert passages.repeated_passages(frame(spark, [])).count() == 0


def test_repeated_passages_of_edited_copies(spark):
    rng = np.random.default_rng(11)
    base = [f"b{i}" for i in range(300)]
    for percent in (2, 3, 5):
        split = {0: base}
        for i in range(1, 201):
            split[i] = [f"e{i}_{k}" if rng.random() < percent / 100 else w for k, w in enumerate(base)]
        seen, want, found = defaultdict(set), defaultdict(set), defaultdict(set)
        for i, w in split.items():
            for p in range(len(w) - 49):
                seen[tuple(w[p : p + 50])].add(i)
        for i, w in split.items():
            for p in range(len(w) - 49):
                if len(seen[tuple(w[p : p + 50])]) > 1:
                    want[i] |= set(range(p, p + 50))
        for r in passages.repeated_passages(frame(spark, [(i, " ".join(w)) for i, w in split.items()])).collect():
            found[r.doc_id] |= set(range(r.start_word, r.end_word))
        assert found == want


def test_short_near_duplicates_behind_a_third_leader(spark):
    # In each group the first text leads every bucket that the other two share, and is linked with neither.
    groups = [
        ("w458203 w137189 w839351 w555981", "w393725 w458203 w137189 w839351 w555981 w791443", "w393725 w458203 w137189 w839351 w555981"),
        ("w766345 w947662 w515517 w207259", "w383967 w766345 w947662 w515517 w207259 w551087", "w383967 w766345 w947662 w515517 w207259"),
        ("w446762 w22144 w726892 w835443", "w446762 w22144 w726892 w835443 w755635 w457267", "w446762 w22144 w726892 w835443 w755635"),
        ("w927881 w387321 w190982 w818344", "w494318 w927881 w387321 w190982 w818344 w743708", "w494318 w927881 w387321 w190982 w818344"),
        ("w89665 w777611 w702147 w686919", "w777597 w89665 w777611 w702147 w686919 w184779", "w777597 w89665 w777611 w702147 w686919"),
        ("w763783 w193734 w308683 w222580", "w979591 w763783 w193734 w308683 w222580 w507563", "w979591 w763783 w193734 w308683 w222580")]
    rows = [(3 * n + k, text) for n, group in enumerate(groups) for k, text in enumerate(group)]
    got = neardup.near_duplicates(frame(spark, rows), 2, 80).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(i, i - 1 if i % 3 == 2 else i) for i, _ in rows}


def test_edits_among_short_words_are_found(spark):
    line = "Members receive printed updates whenever we go on to it or we do so at an office nearby, and another letter follows shortly before winter begins"
    rows = [(1, line), (2, line.replace("on to it", "on by it")), (3, "😀" * 70), (4, "😀" * 70 + "x"), (5, "ab" * 5000), (6, "ab" * 6000)]
    got = {r.doc_id: r.keep_doc_id for r in lines.line_groups(frame(spark, rows)).collect()}
    sets = {i: windows(t) for i, t in rows}
    like = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    assert like(1, 2) and not like(3, 4) and like(5, 6)
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 5}


def test_components_of_links(spark):
    rng = random.Random(9)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(i, i + 1) for i in range(1000, 1200)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    names = sorted({x for a, b in pairs if a != b for x in (a, b)})
    assert got == closed(names, [p for p in pairs if p[0] != p[1]])
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_no_pair_of_lines_at_the_threshold_is_lost(spark):
    rng, rows = random.Random(4), []
    for i in range(3000):
        line = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3)) for _ in range(28)] + ["tails"]
        other = line[:13] + ["QQQ"] + line[14:]  # 96 windows of 120
        if i < 20:
            a, b = windows(" ".join(line)), windows(" ".join(other))
            assert 100 * len(a & b) == 80 * len(a | b)
        rows.append((i, " ".join(line) + "\n" + " ".join(other)))
    got = lines.line_groups(frame(spark, rows)).collect()
    assert {r.copies for r in got} == {2} and len(got) == 6000


def test_minimisers_are_the_last_smallest_of_each_window():
    rng = np.random.default_rng(4)
    for n in (50, 51, 80, 300):
        for distinct in (2, 5, 1000):
            of_run, hashes = passages._chosen(passages._mix(rng.integers(0, distinct, n).astype(np.uint64)), 25, 26)
            for first, at in enumerate(of_run):
                window = hashes[first : first + 26]
                assert first <= at < first + 26 and hashes[at] == window.min() and not (hashes[at + 1 : first + 26] == hashes[at]).any()
