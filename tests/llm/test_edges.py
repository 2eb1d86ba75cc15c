"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for each operator."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quorumlake.llm import langid, lm, media, minhash, mixing, packing, pii, quality, queries, substring, urlfilter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, key string, size string, bands string, train string"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
PASSAGE = " ".join(f"p{i}" for i in range(40))
ROWS = [
    (1, None, None, None), (2, "", "en", "a"), (3, "one", "en", "a"), (4, LONG, "en", "b"), (5, LONG, "en", "b"), (5, LONG, "en", "b"),
    (None, "no id here at all", None, "b"), (6, f"x {PASSAGE} y", "de", "b"), (7, f"z {PASSAGE}", "de", None), (8, " \t\n ", "de", "a"), (9, "mail a@b.co now", "fr", "a"),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0, "x", "x", "x", "x", "x") for r in rows], SCHEMA)


def apply(spark, docs, name):
    import public_tokenizers

    if name == "url":
        return urlfilter.judge(docs.withColumn("url", F.col("text")))
    return {
        "minhash": lambda: minhash.near_duplicates(docs),
        "substring": lambda: substring.deduplicate(docs),
        "quality": lambda: quality.judge(docs),
        "mixing": lambda: mixing.mix(docs),
        "pii": lambda: pii.detect(docs),
        "packing": lambda: packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).where("piece = 0"),
        "langid": lambda: langid.predict(docs, langid.train(docs)),
        "lm": lambda: lm.score(docs, F.crc32(F.col("doc_id").cast("string")) % 10 != 0),
        "media": lambda: media.text_media(docs),
    }[name]()


NAMES = ["minhash", "substring", "quality", "mixing", "pii", "packing", "langid", "lm", "media", "url"]


@pytest.mark.parametrize("name", NAMES)
def test_edge_rows(spark, name):
    assert apply(spark, frame(spark, ROWS), name).count() == len(ROWS)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, name):
    assert apply(spark, frame(spark, []), name).count() == 0


def test_copies_and_empties(spark):
    got = {r["doc_id"]: r for r in minhash.near_duplicates(frame(spark, ROWS)).collect()}
    assert got[5]["component_id"] == 4 and not got[5]["kept"] and got[4]["kept"]
    assert got[1]["n_shingles"] == 0 and got[1]["kept"] and got[2]["component_id"] == 2


def test_shared_passage(spark):
    got = {r["doc_id"]: r for r in substring.deduplicate(frame(spark, ROWS)).collect()}
    assert (got[6]["n_removed"], got[7]["n_removed"]) == (0, 40) and got[5]["n_removed"] == 30_000


def test_pipeline_on_edges(spark):
    held = frame(spark, ROWS)
    for _, stage in corpus_pipeline.STAGES:
        held = stage(spark, held, "")
    held.collect()
    held = frame(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        held = stage(spark, held, "")
    assert held.count() == 0


def test_texts_of_one_id_are_told_apart(spark):
    """Of the near-duplicate stage: a text goes only if another one like it stays, whatever its doc_id."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a, "en", "s"), (1, b, "en", "s"), (1, b, "en", "s"), (2, a, "en", "s"), (None, c, "en", "s"), (None, f"{c} more", "en", "s"), (3, f"{b} more", "en", "s"), (4, "short", "en", "s")]
    kept = corpus_pipeline.near_duplicate_stage(spark, frame(spark, rows), "").collect()
    assert sorted((r["doc_id"] or 0, r["text"][:1]) for r in kept) == [(0, "c"), (2, "a"), (3, "b"), (4, "s")]


def test_language_fold_without_id(spark, tmp_path):
    words = {"en": "the of and to in that", "de": "der die und das nicht ist"}
    rows = [(None if i % 5 == 0 else i, f"{words[lang]} {i}", lang) for i in range(60) for lang in words]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.queries()["op8_langid"](spark, str(tmp_path)).collect()
    assert {r["held_out"] for r in got if r["doc_id"] is None} == {False} and len(got) == len(rows)


def test_many_near_copies(spark):
    """Components of a family of near copies equal those by brute force."""
    rng = random.Random(3)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for k in range(150):
        w = list(base)
        for _ in range(rng.randrange(1, 7)):
            w[rng.randrange(60)] = rng.choice("abcdef")
        rows.append((k, " ".join(w), "en", "s"))
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(frame(spark, rows), k=2).collect()}
    from tests.llm.test_queries import components, shingles

    assert got == components({k: shingles(t, 2) for k, t, _, _ in rows})


def test_index_takes_batches(spark):
    """What batches remove doesn't depend on their number."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abc") + str(rng.randrange(4)) for _ in range(rng.randrange(5, 90))) for _ in range(60)]
    docs = frame(spark, [(k, f"{t} {PASSAGE}" if k % 7 == 0 else t, "en", "s") for k, t in enumerate(texts)])
    one, four = ({tuple(r) for r in substring.deduplicate(docs, batches=b, max_runs=2).collect()} for b in (1, 4))
    assert one == four


def test_cascade_is_exact(spark):
    universe = spark.range(5000).select(F.concat(F.lit("k"), F.col("id")).alias("key"), (F.col("id") % 13 == 0).alias("bad"))
    levels = urlfilter.build_cascade(universe, "bad")
    assert len(levels) > 1 and universe.where(urlfilter.is_listed(levels, F.col("key")) != F.col("bad")).count() == 0


def test_images(spark):
    ppm = b"P6\n2 2\n255\n" + bytes([255, 0, 0, 0, 255, 0, 0, 0, 255, 9, 9, 9])
    got = media.image_columns(spark.createDataFrame([(1, ppm), (2, None), (3, b"junk")], "k long, img binary"), "k", "img").orderBy("k").collect()
    assert (got[0]["height"], got[0]["width"]) == (2, 2) and got[1]["tile"] is None and got[2]["dhash"] is None


def test_training_sample_is_the_least_hashes(spark):
    from pyspark.sql import functions as F

    from quorumlake.llm import langid

    rows = [(i % 90 if i % 7 else None, f"text {i % 50}" if i % 11 else None, ["aa", "bb", None][i % 3]) for i in range(600)] + [(1, "one", "cc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    hashed = docs.where("lang is not null and text is not null").select("lang", "text", "doc_id", F.xxhash64("doc_id").alias("h")).collect()
    want = []
    for lang in ("aa", "bb", "cc"):
        own = sorted((r["h"], r["doc_id"] is not None, r["doc_id"] or 0, r["text"]) for r in hashed if r["lang"] == lang)
        want += [(lang, t) for *_, t in own[:20]]
    assert sorted(tuple(r) for r in langid.sample(docs, 20).collect()) == sorted(want)
    assert langid.sample(docs.where("false"), 20).count() == 0


def test_added_tokens(spark):
    """Added tokens in a text are found as by the tokenizers library."""
    import public_tokenizers
    from tests.llm.test_queries import check_packing

    t = "<|endoftext|>"
    texts = [f"{t} at the start", f"a {t} b", f"at the end {t}", t, t + t, f"  {t}  \n {t}", f"東京{t}🙂 x", "<|endoftext|", "<|<|endoftext|>|>", "none", f"{LONG} {t} {LONG}"]
    rows = packing.pack_documents(frame(spark, [(k, x, "en", "s") for k, x in enumerate(texts)]), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    check_packing(rows, dict(enumerate(texts)), public_tokenizers.path("byte_bpe_50k.json"))


def test_text_without_function_words(spark):
    """A text of 50 words or more without any function word is rejected by its words alone."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(3, 9)))
    text = lambda share: " ".join(rng.choice(["the", "of", "and", "to", "in"]) if rng.random() < share else word() for _ in range(200))
    rows = [(k, text(0.13), "en", "s") for k in range(60)] + [(60, text(0), "en", "s"), (61, text(0), None, "s"), (62, " ".join(text(0).split()[:49]), "en", "s")]
    got = {r["doc_id"]: r for r in quality.judge(frame(spark, rows)).collect()}
    assert [k for k in got if not got[k]["kept"]] == [60, 61] and all(got[k]["class_distance"] <= quality.MAX_CLASS_DISTANCE for k in (60, 61))


def test_phones_with_wide_gaps(spark):
    """Base phones are found in texts without other digits, however many separators lie between theirs."""
    from tests.llm.test_queries import base_pii

    texts = ["+123    456    789", "call +123 -- 456 -- 789 now", "+1 .... 2 ---- 3 (((( 4 )))) 5 .... 6 .... 7 .... 8 .... 9", "tel +49" + " " * 40 + "30.... 12....34....5", "+12    34", "no number"]
    docs = frame(spark, [(k, t, "en", "s") for k, t in enumerate(texts)])
    got = {r["doc_id"]: r for r in pii.detect(docs).collect()}
    for k, t in enumerate(texts):
        spans = [(s, e) for s, _, e, _ in base_pii(t)]
        assert len(spans) == (k < 4) and got[k]["n_phone"] == len(spans) and got[k]["base_spans"] == ",".join(f"phone:{s}:{e}" for s, e in spans)
    assert [r["text"] for r in pii.redact(docs).orderBy("doc_id").collect()] == ["[phone]", "call [phone] now", "[phone]", "tel [phone]", *texts[4:]]


def test_image_kinds():
    """Any maxval, plain bitmaps and palettes decode to bytes."""
    import struct

    flat = lambda b: media.decode(b).reshape(-1).tolist()
    assert flat(b"P5\n2 1\n65535\n" + struct.pack(">2H", 65535, 257)) == [255, 1]
    assert flat(b"P6\n1 1\n15\n" + bytes([15, 0, 3])) == [255, 0, 51]
    assert flat(b"P2\n2 1\n1000\n1000 0") == [255, 0] and flat(b"P1\n3 1\n1 0 1") == flat(b"P1\n3 1\n101") == [0, 255, 0]
    for bits, row in ((8, bytes([1, 0, 0, 0])), (4, bytes([0x10, 0, 0, 0])), (1, bytes([0x80, 0, 0, 0]))):
        bmp = b"BM" + struct.pack("<IHHI", 66, 0, 0, 62) + struct.pack("<IiiHHIIiiII", 40, 2, 1, 1, bits, 0, 4, 0, 0, 2, 0) + bytes([1, 2, 3, 0, 4, 5, 6, 0]) + row
        assert flat(bmp) == [6, 5, 4, 3, 2, 1]


def test_media_query_makes_the_tiles(spark):
    import hashlib

    kept = {r["doc_id"]: r for r in media.text_media(frame(spark, ROWS[:4])).collect()}
    told = {r["doc_id"]: r for r in media.text_media(frame(spark, ROWS[:4]), keep_bytes=False).collect()}
    assert len(told) == 4 and all(told[k]["tile_sha256"] == hashlib.sha256(r["tile"]).hexdigest() for k, r in kept.items())


def test_many_texts_under_one_id(spark):
    """Different texts without an id are different documents, however many there are."""
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [f"doc {i} {passage} end{i * 7}" for i in range(1500)]
    assert sum(r["n_removed"] for r in substring.deduplicate(frame(spark, [(None, t, "en", "s") for t in texts])).collect()) == 1499 * 40


CLASHES = "spans base base_spans n_email own_text class_counts own_lang ref_lang diverges own_words rated_source kept size target rate copies copy own_row root key bands allow_rule bad"


def test_clashing_columns_stay(spark):
    """Every stage carries columns of any name along, with the caller's values."""
    names = CLASHES.split()
    rows = [(k, " ".join(f"the word{i}{k} of x{i * k}y" for i in range(40)), "en", "s", 0) for k in range(8)]
    held = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select("*", *[F.concat(F.lit(f"{c} "), F.col("doc_id")).alias(c) for c in names])
    columns, seen = held.columns, 0
    for _, stage in corpus_pipeline.STAGES[:-1]:
        held = stage(spark, held, "")
        assert held.columns == columns
        got = held.collect()
        assert all(r[c] == f"{c} {r['doc_id']}" for r in got for c in names)
        seen += len(got)
    assert seen and corpus_pipeline.STAGES[-1][1](spark, held, "").count() >= len(got)


def test_operators_keep_the_callers_columns(spark):
    docs = frame(spark, ROWS).withColumns({c: F.lit(c) for c in ("allow_rule", "own_candidates", "class_counts", "rated_source", "url")})
    for made in (urlfilter.judge(docs), pii.detect(docs), quality.judge(docs), mixing.mix(docs)):
        got = made.collect()
        assert len(got) == len(ROWS) and all((r["allow_rule"], r["own_candidates"], r["class_counts"], r["rated_source"]) == ("allow_rule", "own_candidates", "class_counts", "rated_source") for r in got)


def test_a_megabyte_of_numbers(spark):
    """A text with 60,000 numbers is searched and redacted in one sweep."""
    text = " ".join(f"call {i % 1000:03d}-555-{i % 10000:04d} or" if i % 2 else f"+1 {2000000000 + i}," for i in range(60_000))
    docs = frame(spark, [(1, text, "en", "s")])
    r = pii.detect(docs).first()
    assert len(text) > 1_000_000 and r["n_phone"] == 30_000 and len(r["added"]) == 30_000
    assert pii.redact(docs).first()["text"] == " ".join("call [phone] or" if i % 2 else "[phone]," for i in range(60_000))


def test_lists_too_long_for_a_cascade(spark):
    """The join that takes the cascade's place gives the same."""
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(["http://example.com/en/a", "https://www.example.com/en/b?x", "http://a.net/es/", "ftp://NET/fr/q#z", "http://adult-x.example.org", "http://x.cheap-pills.example.net/en/", "none", None, "http://b.org/", "http://b.org/"])], "page_id long, url string")
    one, other = ([tuple(r) for r in urlfilter.judge(pages, cascade=c).orderBy("page_id").collect()] for c in (True, False))
    assert one == other and [r[-1] for r in one] == ["block", "allow", "block", "block", "block", "block", "allow", "allow", "allow", "allow"]


def test_language_by_brute_force(spark):
    """Predictions equal those of plain dictionaries of n-grams, with the model's centroids."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    model = langid.train(docs)

    def cells(text):
        out = [0.0] * langid.DIMENSIONS
        low = text.lower()
        for n in (1, 2, 3):
            for i in range(len(low) - n + 1):
                h = 0
                for c in low[i : i + n]:
                    h = (h * 0x9E3779B1 + ord(c)) % 2**32
                out[(h + n) * 0x85EBCA6B % 2**32 >> 19] += 1
        return out

    import math

    rows = docs.orderBy("doc_id").limit(25).collect()
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    for r in rows:
        v = [math.log1p(c) * float(w) for c, w in zip(cells(r["text"]), model.idf, strict=True)]
        size = math.sqrt(sum(x * x for x in v))
        near = [sum(a * float(b) for a, b in zip(v, c, strict=True) if a) / size for c in model.vectors]
        best = max(range(len(near)), key=near.__getitem__)
        assert got[r["doc_id"]]["lang_pred"] == model.languages[model.owner[best]] and abs(got[r["doc_id"]]["score"] - near[best]) < 1e-4


def test_values_on_edges(spark):
    """Nulls, empty texts, ties and repeated rows have defined values."""
    docs = frame(spark, ROWS)
    mixed = {(r["doc_id"], r["source"]): r for r in mixing.mix(docs).collect()}
    assert mixed[(1, None)]["size"] == 0 and mixed[(1, None)]["taken"] == 0 and mixed[(7, None)]["source_size"] == 41
    judged = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    assert judged[1]["n_words"] == 0 and judged[1]["base_failed"] and not judged[2]["kept"] and judged[4]["n_repeat_words"] == judged[5]["n_repeat_words"]
    spans = {r["doc_id"]: r["spans"] for r in pii.detect(docs).collect()}
    assert spans[9] == "email:5:11" and spans[1] == "" and spans[2] == ""
    said = {r["doc_id"]: r for r in langid.predict(docs, langid.train(docs)).collect()}
    assert [(said[k]["lang_pred"], said[k]["score"], said[k]["rejected"]) for k in (1, 2, 8)] == [("und", 0.0, True)] * 3
    scored = {r["doc_id"]: r for r in lm.score(docs, F.lit(True)).collect()}
    assert scored[1]["n_tokens"] == scored[2]["n_tokens"] == scored[8]["n_tokens"] == 1 and scored[4]["score"] == scored[5]["score"]
    made = {r["doc_id"]: r for r in media.text_media(docs).collect()}
    assert made[1]["payload_bytes"] == 192 and made[1]["n_bytes"] == 0 and made[1]["media_sha256"] == made[2]["media_sha256"] and made[4]["feature"] == made[5]["feature"]
