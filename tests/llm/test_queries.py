"""The queries of the corpus operators against SQL and brute-force versions, on the smallest tables."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quorumlake.llm import queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def result(spark, name):
    rows = queries.queries()[name](spark, SF).collect()
    return {r["doc_id"]: r for r in rows}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    frame, asked = queries.queries()[name](spark, SF), con.sql(queries.oracle_sql()[name])
    cols = sorted(frame.columns)
    assert cols == sorted(asked.columns)
    at = [asked.columns.index(c) for c in cols]
    assert Counter(tuple(str(r[c]) for c in cols) for r in frame.collect()) == Counter(tuple(str(r[i]) for i in at) for r in asked.fetchall())


def base_quality(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = set()
    for i in range(len(words) - 4):
        if windows[tuple(words[i : i + 5])] > 1:
            hit.update(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_quality_base(spark, docs):
    got = result(spark, "op3_quality")
    for k, d in docs.items():
        n = base_quality(d["text"])
        r = got[k]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == n
        assert r["base_failed"] == (n[0] < 10 or 100 * n[4] > 20 * n[0])
        assert not (r["base_failed"] and r["kept"])


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_pii(text):
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9](?:[ -]?[0-9])+", lambda m: 12 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
        ("phone", r"\+[0-9][ ().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    ]
    return [(m.start(), i, m.end(), k) for i, (k, p, ok) in enumerate(kinds) for m in re.finditer(p, text or "") if ok(m.group())]


def test_pii_base(spark, docs):
    got = result(spark, "op5_pii")
    for k, d in docs.items():
        spans = sorted(base_pii(d["text"]))
        joined = ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in spans)
        assert got[k]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(got[k]["spans"].split(","))
        assert got[k]["n_email"] == sum(s[3] == "email" for s in spans)


def check_packing(rows, texts, tokenizer_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path)
    bins = defaultdict(list)
    pieces = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append(r)
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    assert set(pieces) == set(texts)
    for k, own in pieces.items():
        ids = [*tokenizer.encode(texts[k] or "", add_special_tokens=False).ids, 2]
        own = sorted(own, key=lambda r: r["piece"])
        assert [r["length"] for r in own][1:] == [1024] * (len(own) - 1) and sum(r["length"] for r in own) == len(ids)
        for r in own:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert zlib.crc32(struct.pack(f"<{len(part)}I", *part)) == r["ids_crc32"]
    total = sum(r["length"] for r in rows)
    assert len(bins) <= 1.05 * total / 1024 + 2


def test_packing(spark, docs):
    import public_tokenizers

    rows = queries.queries()["op6_packing"](spark, SF).collect()
    check_packing(rows, {k: d["text"] for k, d in docs.items()}, public_tokenizers.path("byte_bpe_50k.json"))


def test_langid(spark, docs):
    got = result(spark, "op8_langid")
    held = [k for k in docs if zlib.crc32(str(k).encode()) % 4 == 2]
    assert {k for k, r in got.items() if r["held_out"]} == set(held)
    assert sum(got[k]["lang_pred"] == docs[k]["lang"] for k in held) >= 0.9 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_lm_base(spark, docs):
    got = result(spark, "op9_lm")
    words = {k: [*[w.lower() if w.isascii() else re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in WORD.findall(d["text"] or "")], None] for k, d in docs.items()}
    train = [k for k in docs if zlib.crc32(str(k).encode()) % 10 != 0]
    c = Counter(w for k in train for w in words[k])
    n, v = sum(c.values()), len(c)
    for k, own in words.items():
        r = got[k]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (k not in train, len(own), sum(c[w] > 0 for w in own), n)
        want = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        assert abs(r["base_score"] - want) < 1e-6 * max(1, abs(want))
        assert r["score"] < 0
    held = [k for k in docs if k not in train]
    assert sum(got[k]["score"] for k in held) > sum(got[k]["base_score"] for k in held)


def test_media_round_trip(spark, docs):
    got = result(spark, "op10_media")
    for k, d in docs.items():
        raw = (d["text"] or "").encode()
        padded = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        r = got[k]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))


def test_mix_near_targets(spark):
    rows = queries.queries()["op4_mixing"](spark, SF).collect()
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    assert abs(sum(r["taken"] for r in rows) - sum(r["size"] for r in rows)) < 0.25 * sum(r["size"] for r in rows)


def test_pipeline(spark, docs):
    import public_tokenizers

    held = spark.read.parquet(f"{SF}/documents.parquet")
    columns, frames = held.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        held = stage(spark, held, SF).cache()
        frames[name] = held
        if name != "packing":
            assert held.columns == columns
    quality = {r["doc_id"]: r["text"] for r in frames["quality"].collect()}
    assert all(quality[k] == docs[k]["text"] for k in quality) and len(quality) > 0.5 * len(docs)
    sets = {k: shingles(t, 5) for k, t in quality.items()}
    left = {r["doc_id"] for r in frames["near_duplicates"].collect()}
    root = components(sets)
    assert left == {k for k in sets if root[k] == k}
    redacted = {r["doc_id"]: r["text"] for r in frames["pii"].collect()}
    assert set(redacted) == left and not any(base_pii(t) for t in redacted.values())
    mixed = Counter(r["doc_id"] for r in frames["mixing"].collect())
    assert set(mixed) <= left and max(mixed.values()) <= 3
    packed = frames["packing"].collect()
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == mixed
    assert public_tokenizers


def shingles(text, k):
    w = [x.lower() for x in re.sub("[A-Z]", lambda m: m.group().lower(), text or "").encode().split()]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(sets, num=80, den=100):
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if min(len(sets[a]), len(sets[b])) * den >= num * max(len(sets[a]), len(sets[b])) and (c := len(sets[a] & sets[b])) and den * c >= num * (len(sets[a]) + len(sets[b]) - c):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in keys}
