"""Alignments, fuzzy names, micro-batches and grids against plain Python."""

import random

from quorumlake.operators import align, packing
from quorumlake.sources import readers


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_error_rates(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)] + ["It's", "x,y"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 200))), " ".join(rng.choices(words[:40], k=rng.randint(0, 200)))) for i in range(20)]
    rows += [(90, None, None), (91, "a", None), (92, "", "b"), (93, "!?", "-"), (94, "A b", "a  B.")]
    plain = lambda t: [w for w in ("".join(c for c in x if c.isascii() and (c.isalnum() or c == "'")) for x in (t or "").lower().split()) if w]
    got = {r["k"]: (r["wer"], r["cer"]) for r in align.error_rates(spark.createDataFrame(rows, "k long, a string, b string"), "a", "b").collect()}
    for k, a, b in rows:
        x, y = plain(a), plain(b)
        want = (distance(x, y) / len(x), distance(" ".join(x), " ".join(y)) / len(" ".join(x))) if x and y else (float(bool(x or y)),) * 2
        assert all(abs(g - w) < 1e-12 for g, w in zip(got[k], want, strict=True)), k


def test_timed_agreement(spark):
    def units(text, shift=0.0):
        return None if text is None else [(w, i + shift) for i, w in enumerate(text.split())]

    rows = [(0, units("a b c d"), units("a x c d", 0.5)), (1, units("a b c"), units("b c", 2.0)), (2, None, units("a")), (3, None, None), (4, units(""), units(""))]
    got = {r["k"]: (r["agreement"], r["delta"], r["drifts"]) for r in align.timed_agreement(spark.createDataFrame(rows, "k long, a array<struct<word:string,start:double>>, b array<struct<word:string,start:double>>"), "a", "b").collect()}
    assert got == {0: (0.75, 0.5, False), 1: (1 - 1 / 3, 1.0, True), 2: (0.0, 0.0, False), 3: (1.0, 0.0, False), 4: (1.0, 0.0, False)}


def test_canonical_names(spark):
    roster = spark.createDataFrame([("b", "Vicki Byrd"), ("b", "Jon Smith"), ("b", "Jan Smith"), ("c", "Ann Lee")], "body string, name string")
    asked = [("b", "Vicky Byrd", "Vicki Byrd"), ("b", "jan  smith", "Jan Smith"), ("b", "Jun Smith", "Jun Smith"), ("c", "Vicky Byrd", "Vicky Byrd"), ("b", "Vicki Byrd Jr", "Vicki Byrd Jr"), ("b", None, None), ("b", "", ""), (None, "Ann Lee", "Ann Lee")]
    got = align.canonical_names(spark.createDataFrame([a[:2] for a in asked], "body string, name string"), roster, "body", "name").collect()
    assert sorted(map(repr, ((r["body"], r["name"], r["canonical"]) for r in got))) == sorted(map(repr, asked))


def test_microbatches(spark):
    rng = random.Random(5)
    rows = [(g, rng.choice([0, 1, 2, 3, 7, 7, 7, 20, 45, 300])) for g in "abcde" for _ in range(rng.randint(1, 400))] + [("z", None)]
    got = {r["g"]: (r["batches"], r["padded"]) for r in packing.microbatches(spark.createDataFrame(rows, "g string, n long"), "g", "n", 100).collect()}
    for g in "abcde":
        open_rows, made, padded = [], 0, 0
        for n in sorted(n for k, n in rows if k == g):
            if open_rows and (len(open_rows) + 1) * n > 100:
                made, padded, open_rows = made + 1, padded + len(open_rows) * open_rows[-1], []
            open_rows.append(n)
        assert got[g] == (made + 1, padded + len(open_rows) * open_rows[-1])
    assert "z" not in got


def test_packs_of_many_keys_and_nulls(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["a", "b", "c", None]), i, rng.choice([None, 1, 4, 9, 30])) for i in range(500)]
    got = {r["k"]: r["pack"] for r in packing.pack_in_order(spark.createDataFrame(rows, "g string, k long, n long"), "g", ["k"], "n", 20).collect()}
    state = {}
    for g, k, n in rows:
        pack, load = state.get(g, (0, 0))
        if load and load + (n or 0) > 20:
            pack, load = pack + 1, 0
        state[g] = (pack, load + (n or 0))
        assert got[k] == pack


def test_grid_rows(spark):
    def row(body, href, kind="rgRow"):
        return f'<tr class="{kind}" id="r"><td><a id="c0_hypBody" href="#">{body}</a></td><td><a href="{href}" id="c0_hypAgenda">Agenda</a></td><td><span id="c0_lblTime">6:30 PM</span></td></tr>'

    pages = [(1, "<table>" + row("Parks &amp; Trees", "a?x=1&amp;y=2") + row("Council", "b", "rgAltRow") + "</table>"), (2, row("Council", "b", "rgAltRow") + row("Zoning", "c") + '<tr class="pager"><td>2</td></tr>'), (3, None)]
    got = readers.grid_rows(spark.createDataFrame(pages, "page long, html string"), "page", "html", ["hypBody", "hypAgenda", "lblTime"]).orderBy("page", "seq").collect()
    assert [(r["page"], r["hypBody"], r["hypAgenda_link"], r["lblTime"], r["lblTime_link"]) for r in got] == [(1, "Parks & Trees", "a?x=1&y=2", "6:30 PM", None), (1, "Council", "b", "6:30 PM", None), (2, "Zoning", "c", "6:30 PM", None)]
