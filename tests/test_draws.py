"""Alignments as rows against the full table, and draws of a fixed number."""

import random

import numpy as np

from quorumlake.operators import align, stats


def full_table(a, b):
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
    i, j, out = len(a), len(b), []
    while i or j:
        if i and j and d[i][j] == d[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            i, j = i - 1, j - 1
            out.append((i, j))
        elif i and d[i][j] == d[i - 1][j] + 1:
            i -= 1
            out.append((i, None))
        else:
            j -= 1
            out.append((None, j))
    return out[::-1]


def test_pairs_equal_those_of_the_full_table():
    rng = random.Random(6)
    for n, m in [(0, 0), (0, 5), (5, 0), (1, 1), (1, 9), (9, 1), *[(rng.randrange(0, 70), rng.randrange(0, 70)) for _ in range(150)]]:
        a, b = ([rng.choice("abcd") for _ in range(k)] for k in (n, m))
        assert align.word_pairs(np.array(a, object), np.array(b, object)) == full_table(a, b)


def test_aligned_rows(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"], ["a", "c"]), (2, None, ["x"]), (3, [], None)], "k long, l array<string>, r array<string>")
    got = [tuple(r) for r in align.aligned_words(df, ["k"], "l", "r").orderBy("k", "seq").collect()]
    assert got == [(1, 0, 0, 0, "a", "a"), (1, 1, 1, None, "b", None), (1, 2, 2, 1, "c", "c"), (2, 0, None, 0, None, "x")]


def test_each_replicate_draws_all(spark):
    rng = np.random.default_rng(3)
    rows = [("g" if i % 3 else None, int(i), float(v)) for i, v in enumerate(rng.normal(5, 2, 900))]
    df = spark.createDataFrame(rows, "g string, c int, v double")
    one, again = ({r["g"]: tuple(round(x, 9) for x in tuple(r)[1:]) for r in stats.bootstrap_fixed(d, ["g"], "c", "v", 400, "s", 50).collect()} for d in (df, df.repartition(7)))
    assert one == again and {g: r[3] for g, r in one.items()} == {"g": 600, None: 300}
    for g, (mean, low, high, _) in one.items():
        own = np.array([v for k, _, v in rows if k == g])
        wide = 2 * 1.96 * own.std() / len(own) ** 0.5
        assert abs(mean - own.mean()) < 1e-8 and low < mean < high and 0.8 < (high - low) / wide < 1.2
    assert stats.bootstrap_fixed(df, [], "c", "v", 20, "s").first()["draws"] == 900
