"""Each query of the catalog against the SQL that DuckDB runs for it, on the smallest tables."""

import math
from collections import Counter

import duckdb
import pytest

from quorumlake.plans import archive, catalog, ledgers, provided, search, upkeep  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return str(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(archive.SQL))
def test_against_sql(spark, duck, name):
    frame = catalog.QUERIES[name](spark, SF)
    asked = duck.sql(catalog.SQL[name])
    cols = sorted(frame.columns)
    assert cols == sorted(asked.columns)
    own = Counter(tuple(plain(r[c]) for c in cols) for r in frame.collect())
    at = [asked.columns.index(c) for c in cols]
    assert own == Counter(tuple(plain(r[i]) for i in at) for r in asked.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_profiles_of_all_rows(spark, tmp_path):
    """A reference of any id can be matched, and no row matches itself."""
    rows = [(0, [1.0, 0.0], 1), (10, [-1.0, 0.0], 4), (60, [0.0, 1.0], 2), (77, [1.0, 0.1], 3), (1077, [0.1, 1.0], 5)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalog.QUERIES["profile_matches_all"](spark, str(tmp_path)).collect()
    assert {r["vec_id"]: r["person"] for r in got} == {0: 3, 60: 5}


def test_best_of_all_in_pieces(spark):
    """Many small pieces give what one large one gives; vectors without a direction score -1, ones of another length too."""
    import random

    from quorumlake.functions import nearest

    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(300)] + [(300, [0.0] * 4), (301, None), (302, [1.0]), (303, [1.0, None, 0.0, 0.0]), (304, rng.choices([0.5], k=4)), (305, [0.5] * 4)]
    e = spark.createDataFrame(rows, "id long, vec array<float>")
    asked = e.where("id % 7 = 0 or id >= 300")
    one, many = ({r["id"]: tuple(r) for r in nearest.best_of_all(asked, e, piece).collect()} for piece in (1000, 40))
    assert one == many and len(one) == asked.count()
    assert one[304][1:3] == (1.0, 305) and one[305][2] == 304
    assert all(one[i][1:] == (-1.0, 0, -1.0) for i in (300, 301, 302, 303))


def test_visits_leave_in_small_batches(spark):
    import numpy as np

    from quorumlake.functions import nearest

    pivots = np.eye(32)
    q = spark.range(3000, numPartitions=1).selectExpr("id", "transform(sequence(1, 32), i -> 0.17677669529663687D) AS vec", "0 AS block", "CAST(NULL AS double) AS best")
    visited = nearest.visits(q, pivots, np.zeros(32), np.full(32, 2.0))
    counts = visited.mapInPandas(lambda batches: (type(b)({"n": [len(b)]}) for b in batches), "n long").collect()
    assert sum(r["n"] for r in counts) == 3000 * 31
    assert nearest.SLICE * nearest.PIECE * 8 <= 16_000_000
