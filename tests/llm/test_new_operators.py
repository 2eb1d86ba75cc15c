"""The Jaccard join, vector codes and ranked search against brute force, and on nulls, ties, repeats and empty tables."""

import hashlib
import heapq
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quorumlake.llm import codes, jaccard, ranked
from tests.llm.test_edges import LONG, PASSAGE, ROWS, frame
from tests.llm.test_queries import shingles

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


# ---- N-gram Jaccard join --------------------------------------------------------------------------------------------


def families(seed, n=160, words=70):
    """Texts of a few families, with edits, exact copies, and a passage that several families share."""
    rng = random.Random(seed)
    bases = [[f"f{b}w{i}" for i in range(words)] for b in range(4)]
    shared = [f"s{i}" for i in range(40)]
    out = []
    for k in range(n):
        w = list(bases[k % 4])
        for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
            w[rng.randrange(len(w))] = rng.choice("xyz") + str(rng.randrange(3))
        if k % 4 < 2:
            w[10:10] = shared
        out.append((k, " ".join(w), "en", "s"))
    return out


def linked_sets(sets, up, down):
    keys, links = sorted(k for k in sets if sets[k]), set()
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            common = len(sets[a] & sets[b])
            if down * common >= up * (len(sets[a]) + len(sets[b]) - common):
                links.add((a, b))
    return links


def by_links(keys, links):
    root = {k: k for k in keys}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return {k: top(k) for k in keys}


@pytest.mark.parametrize("k,least,seed", [(4, (85, 100), 1), (5, (80, 100), 2), (2, (60, 100), 3)])
def test_join_finds_all_components(spark, k, least, seed):
    rows = families(seed)
    sets = {d: shingles(t, k) for d, t, _, _ in rows}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.components(frame(spark, rows), k=k, least=least).collect()}
    want = by_links(sets, linked_sets(sets, *least))
    assert got == {d: (len(sets[d]), want[d]) for d in sets}


def test_join_gives_all_links(spark):
    rows = families(7, 90)
    sets = {d: shingles(t, 4) for d, t, _, _ in rows}
    found, members = jaccard.links(frame(spark, rows), k=4, least=(85, 100))
    of = defaultdict(list)
    for r in members.collect():
        of[bytes(r["class"])].append(r["doc_id"])
    got = {tuple(sorted((a, b))) for r in found.collect() for a in of[bytes(r["a"])] for b in of[bytes(r["b"])]}
    got |= {(a, b) for ids in of.values() for a in ids for b in ids if a < b}
    assert got == linked_sets(sets, 85, 100)


def test_join_on_edges(spark):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.components(frame(spark, ROWS)).collect()}
    assert {(1, 0, 1), (2, 0, 2), (3, 1, 3), (8, 0, 8), (None, 1, None)} <= got
    assert {c for d, _, c in got if d in (4, 5)} == {4}
    assert jaccard.components(frame(spark, ROWS)).count() == len(ROWS)
    assert jaccard.components(frame(spark, [])).count() == 0
    two = [(1, LONG, "en", "a"), (1, PASSAGE, "en", "a"), (2, PASSAGE, "en", "a"), (None, LONG, "en", "a")]
    assert sorted(tuple(r)[1:] for r in jaccard.components(frame(spark, two)).collect()) == [(36, 1), (36, 1), (977, 1), (977, 1)]


def test_hashes_of_a_batch():
    """Hashes don't depend on the texts around, on case or on which white space there is, and equal words alone give equal hashes."""
    texts = ["Ab c  d\te F", None, "", "ab C d e f ", "x" * 3_000_000 + " y", "é ab c d e f", "\x0bab c", "ab c"]
    made = jaccard.Shingles(3)
    both = made.of(pa.array(texts))
    for t, got in zip(texts, both):
        assert (jaccard.Shingles(3).of(pa.array([t], pa.string()))[0] == got).all()
    assert [len(x) for x in both] == [3, 0, 0, 3, 1, 4, 1, 1]
    assert (both[0] == both[3]).all() and set(both[0]) < set(both[5]) and both[6] == both[7]


# ---- vector codes ---------------------------------------------------------------------------------------------------


def brute_codes(rows, parts=8, entries=16, rounds=6):
    kept = sorted((k, [math.floor(4096 * v) for v in x], label) for k, x, label in rows if x and all(v is not None and math.isfinite(v) for v in x))
    width = len(kept[0][1]) // parts
    cut = lambda x, p: x[p * width : (p + 1) * width]
    books = [[cut(x, p) for _, x, _ in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((i - j) ** 2 for i, j in zip(a, b))
    nearest = lambda v, book: min(range(len(book)), key=lambda e: (far(v, book[e]), e))
    for _ in range(rounds):
        for p, book in enumerate(books):
            groups = defaultdict(list)
            for _, x, _ in kept:
                groups[nearest(cut(x, p), book)].append(cut(x, p))
            books[p] = [[sum(c) // len(groups[e]) for c in zip(*groups[e])] if e in groups else book[e] for e in range(len(book))]
    out, by_label = {}, Counter()
    for k, x, label in kept:
        own = [nearest(cut(x, p), books[p]) for p in range(parts)]
        error = sum(far(cut(x, p), books[p][e]) for p, e in enumerate(own))
        out[k] = ("".join(f"{e:02x}" for e in own), error, label)
        by_label[label] += error
    return {k: (c, e, by_label[label]) for k, (c, e, label) in out.items()}, hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()


VECTORS = "vec_id long, embedding array<float>, label int, code string, id long, x string"


@pytest.mark.parametrize("spread", [1.0, 0.002])
def test_codes_equal_plain_lloyd(spark, spread):
    """With a small spread most distances are ties."""
    rng = np.random.default_rng(11)
    rows = [(i, [float(v) for v in (rng.normal(size=16) * spread).astype(np.float32)], None if i % 5 == 0 else i % 3) for i in range(400)]
    rows += [(1000, None, 1), (1001, [None] * 16, 1), (1002, [float("nan")] * 16, 1), (-5, [float("-inf")] + [0.0] * 15, 1)]
    coded, books = codes.compress(spark.createDataFrame([(*r, "c", 0, "x") for r in rows], VECTORS))
    want, sha = brute_codes(rows)
    assert {r["vec_id"]: (r["code"], r["error"], r["label_error"]) for r in coded.collect()} == want and codes.digest(books) == sha


def test_codes_on_edges(spark):
    make = lambda rows: spark.createDataFrame([(*r, "c", 0, "x") for r in rows], VECTORS)
    assert codes.compress(make([]))[0].count() == 0 and codes.compress(make([(1, None, 1), (2, [], 1), (3, [1.0, 2.0], 1)]))[0].count() == 0
    few = [(1, [1.0] * 8, 1), (1, [1.0] * 8, 1), (None, [2.0] * 8, None), (2, [3.0] * 16, 1), (3, [3e38] * 8, 2), (4, [-3e38] * 8, 2)]
    coded, books = codes.compress(make(few))
    got = sorted((r["vec_id"] or 9, r["code"], r["error"]) for r in coded.collect())
    assert got == [(1, "00" * 8, 0), (1, "00" * 8, 0), (3, "02" * 8, 0), (4, "03" * 8, 0), (9, "04" * 8, 0)] and books.shape == (8, 5, 1)
    assert abs(books).max() == 1 << 28


def test_bounds_leave_groups_out():
    """In settled rounds most groups aren't scanned, and the codes are those of a full scan."""
    rng = np.random.default_rng(5)
    centres = rng.integers(-4000, 4000, (16, 8))
    x = centres[rng.integers(0, 16, 3000)] + rng.integers(-300, 300, (3000, 8))
    groups, scanned = codes.grouped(centres), []
    own = np.zeros(3000, np.int64)
    upper, lower = np.zeros(3000), np.zeros((3000, codes.GROUPS))
    codes.assign(x, own, upper, lower, centres, groups, None)
    plain, before = codes.squared, codes.squared
    for step in range(3):
        book = centres + rng.integers(-15, 15, centres.shape)
        drift = np.sqrt(((book - centres) ** 2).sum(axis=1)) * (1 + codes.SLACK)
        try:
            codes.squared = lambda a, b: (scanned.append(len(a) * len(b)), plain(a, b))[1]
            codes.assign(x, own, upper, lower, book, groups, drift)
        finally:
            codes.squared = before
        assert (own == plain(x, book).argmin(axis=1)).all()
        centres = book
    assert sum(scanned) < 0.2 * 3 * 3000 * 16


# ---- ranked search --------------------------------------------------------------------------------------------------


def brute_search(docs, items, k=10):
    terms = [(d, TERM.findall(lowered(t))) for d, t in docs]
    terms = [(d, t, Counter(t)) for d, t in terms if t]
    n_docs, n_terms = len(terms), sum(len(t) for _, t, _ in terms)
    df = Counter(x for _, _, c in terms for x in c)
    out = []
    for item, text in items:
        scores = []
        asked = [(x, math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1)))) for x in set(TERM.findall(lowered(text))) if x in df]
        for d, t, c in terms:
            m = 10 + (90 * len(t) * n_docs) // n_terms
            score = sum(w * ((10**9 * c[x]) // (1000 * c[x] + 8 * m)) for x, w in asked if x in c)
            if score > 0:
                scores.append((-score, d is None, d or 0))
        out += [(item, i + 1, None if none else d, -s) for i, (s, none, d) in enumerate(heapq.nsmallest(k, scores))]
    return sorted(out, key=str)


def test_search_equals_brute_force(spark):
    rng = random.Random(9)
    words = [f"{c}{i}" for i in range(12) for c in "aBé中"]
    docs = [(i, rng.choice(["", " ", "-"]).join(rng.choice(words) + rng.choice([" ", ".", "\n", "\x00"]) for _ in range(rng.randrange(0, 60)))) for i in range(300)]
    docs += [(5000 + i, docs[i % 7][1]) for i in range(40)] + [(None, docs[3][1]), (77, None)]
    items = [(i, " ".join(rng.choice(words).upper() for _ in range(rng.randrange(0, 9)))) for i in range(50)] + [(None, "a1 B2"), (3, "a1"), (90, None), (91, "nowhere")]
    d = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, rank int, n long").repartition(5)
    q = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, score long")
    for terms in (ranked.BLOCK_TERMS, 25):
        got = sorted(map(tuple, ranked.search(d, q, block_terms=terms).collect()), key=str)
        assert got == brute_search(docs, items)


def test_search_on_edges(spark):
    d, q = frame(spark, ROWS), spark.createDataFrame([(1, "no p1 W5 w5 one"), (2, "")], "item_id long, text string")
    got = ranked.search(d, q).collect()
    assert sorted(map(tuple, got), key=str) == brute_search([(r[0], r[1]) for r in ROWS], [(1, "no p1 W5 w5 one"), (2, "")])
    assert ranked.search(frame(spark, []), q).count() == 0 and ranked.search(d, q.limit(0)).count() == 0


def test_radix_order_is_stable():
    rng = np.random.default_rng(2)
    for bits in (3, 17, 40, 62):
        keys = rng.integers(0, 1 << bits, 5000).astype(np.uint64)
        assert (ranked.radix_order(keys) == np.argsort(keys, kind="stable")).all()
    assert len(ranked.radix_order(np.zeros(0, np.uint64))) == 0
