"""Learned operators, media and the pipeline: held-out accuracy, exact enumeration, exact round trips, brute force."""

import hashlib
import itertools
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import compression, jpeg, language, queries, toxicity

LANGS = {"en": "the of and to in that is with for this from river light house water small".split(), "de": "der die und das ist nicht mit auf für eine haus wasser licht über schön klein".split(), "fr": "le la les et des que une dans pour avec maison eau lumière très petite être".split()}


def say(rng, lang, n):
    return " ".join(rng.choice(LANGS[lang]) for _ in range(n))


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema).selectExpr("*", "1 as _y", "'k' as _k", "2 as score", "true as held_out")


# ---- language


def brute(word, pieces, p):
    """Sum over all segmentations, by listing them."""
    w = language.START + word
    total = np.zeros(p.shape[1])
    for cuts in itertools.product([0, 1], repeat=len(w) - 1):
        at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(w)]
        q = np.ones(p.shape[1])
        for s, e in itertools.pairwise(at):
            k = pieces.get(w[s:e], len(pieces) if e - s == 1 else None)
            q = q * (p[k] if k is not None else 0)
        total += q
    return np.log(total)


def test_forward_sums_all_segmentations():
    rng = np.random.default_rng(0)
    pieces = {x: i for i, x in enumerate([language.START, "a", "b", "ab", "ba", language.START + "a", "aab", "bb", language.START + "ab"])}
    p = rng.uniform(0.01, 0.2, (len(pieces) + 1, 3))
    words = ["".join(x) for n in range(1, 8) for x in itertools.islice(itertools.product("abz", repeat=n), 0, 60, 7)]
    got = language.word_logs(words, pieces, p)
    for w, g in zip(words, got, strict=True):
        assert np.allclose(g, brute(w, pieces, p))
        assert np.allclose(language.long_word(language.START + w, language.as_pieces(pieces), p), g)  # log scale gives the same
    assert np.isfinite(language.word_logs(["ab" * 5000], pieces, p)).all()


def test_expected_counts_are_posteriors():
    from collections import Counter

    pieces = {language.START: 0, "a": 1, "aa": 2}
    p = np.array([0.5, 0.3, 0.2, 0.01])
    c = language.expected(Counter({"aa": 2}), pieces, p)
    one, two = 0.5 * 0.3 * 0.3, 0.5 * 0.2
    assert np.allclose(c[:3], [2, 2 * 2 * one / (one + two), 2 * two / (one + two)])


def test_long_words_count_like_short_ones(monkeypatch):
    """The log-scale recursions for words of any length, against the matrices for short ones."""
    from collections import Counter

    rng = np.random.default_rng(2)
    pieces = {x: i for i, x in enumerate([language.START, "a", "b", "ab", "ba", language.START + "a", "aabbaabbaabba", "bb"])}
    p = rng.uniform(0.01, 0.2, len(pieces) + 1)
    words = Counter({"aabbaabbaabbab": 3, "zab": 2, "a": 1, "aabbaabbaabba" * 2: 1})
    short = language.expected(words, pieces, p)
    monkeypatch.setattr(language, "LINEAR", 0)
    assert np.allclose(language.expected(words, pieces, p), short) and short[6] > 0  # pieces of over ten characters count


def test_letters_are_what_isalpha_says():
    text = "½ ² ① Ⅷ 4 _ a½b été x²y ǅ ªº 字ー々 ٣ Ⅷabc café1de"
    assert language.letters(text) == "".join(c if c.isalpha() else " " for c in text).split()
    assert language.letters("½ ² ① Ⅷ 4 _") == []


@pytest.mark.skipif(not os.path.exists(language.VOCABULARY), reason="no vocabulary")
def test_language_held_out(spark):
    rng = random.Random(1)
    rows = [(i, say(rng, lang, rng.randint(4, 60)), lang) for i, lang in enumerate(["en", "de", "fr"] * 60)]
    rows += [(900, None, "en"), (901, "123 !? ½²①Ⅷ", "de"), (902, say(rng, "de", 20_000), None), (903, "x" * 3000, "fr"), (904, "Zug", None), (904, "Zug", None), (None, say(rng, "en", 9), "en")]
    d = frame(spark, rows, "doc_id long, text string, lang string")
    got = language.predict(d).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, *_ in rows if i is not None)
    assert np.mean([by[i]["lang_pred"] == x for i, _, x in rows[:180]]) > 0.97
    assert by[900]["lang_pred"] == by[901]["lang_pred"] == "und" and by[902]["lang_pred"] == "de" and all(0 <= r["score"] <= 1 for r in got)
    assert language.predict(d.limit(0)).count() == 0
    assert {r["lang_pred"] for r in language.predict(d.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# ---- quality


def quality_rows():
    rng = random.Random(3)
    rows = []
    for i in range(400):
        good = i % 3 > 0
        text = say(rng, rng.choice(list(LANGS)), rng.randint(20, 150))
        rows.append((i, text if good else rng.choice([text.upper().replace(" ", "!! "), " ".join([text.split()[0]] * 60), text.replace(" ", "### ")]), int(good)))
    return rows


def test_quality_held_out(spark):
    rows = quality_rows()
    extra = [(900, None), (901, ""), (902, rows[1][1] * 400), (901, ""), (None, rows[1][1])]
    d = frame(spark, [(i, t) for i, t, _ in rows] + extra, "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(5000, 1, 0), (902, None, 0)], "doc_id long, quality int, toxic int")
    got = compression.classify(d, labels).collect()
    assert len(got) == len(rows) + len(extra)
    by = {r["doc_id"]: r for r in got}
    held = [(by[i], q) for i, _, q in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(r["held_out"] for r, _ in held) and np.mean([r["predicted"] == q for r, q in held]) > 0.93
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    kept = {r["doc_id"] for r in compression.keep_good(d, labels).collect()}
    assert kept == {r["doc_id"] for r in got if r["predicted"]}
    assert compression.classify(d.limit(0), labels).count() == 0
    assert {r["score"] for r in compression.classify(d, labels.limit(0)).collect()} == {0.5}
    one = compression.classify(d, labels.where("quality = 1")).collect()
    assert {r["score"] for r in one} == {1.0}


def test_every_piece_of_a_text_counts():
    m = compression.fit([(i, t, q) for i, t, q in quality_rows()], 0.6)
    good = quality_rows()[1][1]
    bad = " ".join(["SPAM!!"] * 20_000)
    a, b = compression.sizes([good.encode(), (good + bad).encode()], m.good, m.bad)
    assert b[0] > a[0] + 500 and b[2] == len((good + bad).encode())


# ---- toxicity


def test_toxicity_held_out_and_misspelled(spark):
    rng = random.Random(5)
    bad = ["scoundrel", "nitwit", "blockhead"]
    rows = []
    for i in range(500):
        w = say(rng, rng.choice(list(LANGS)), rng.randint(30, 200)).split()
        if i % 3 == 0:
            for _ in range(max(2, len(w) // 30)):
                w[rng.randrange(len(w))] = rng.choice(bad)
        rows.append((i, " ".join(w), int(i % 3 == 0)))
    clean, odd = say(rng, "en", 60), say(rng, "en", 60).split()
    for k in (3, 20, 40):
        odd[k] = "blockheadz"
    extra = [(900, None), (901, " . "), (902, say(rng, "en", 30_000)), (903, " ".join(odd)), (904, clean), (904, clean), (None, clean)]
    d = frame(spark, [(i, t) for i, t, _ in rows] + extra, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    got = toxicity.classify(d, labels).collect()
    assert len(got) == len(rows) + len(extra)
    by = {r["doc_id"]: r for r in got}
    held = [(by[i], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(r["held_out"] for r, _ in held) and np.mean([r["predicted"] == y for r, y in held]) > 0.95
    assert by[903]["score"] > 10 * by[904]["score"] and by[904]["predicted"] == 0 and by[902]["predicted"] == 0
    assert all(0 <= r["score"] <= 1 for r in got) and by[900]["score"] == by[901]["score"]
    assert toxicity.classify(d.limit(0), labels).count() == 0
    assert {r["score"] for r in toxicity.classify(d, labels.limit(0)).collect()} == {0.5}


def test_toxicity_of_long_runs():
    for n in (49, 56, 57, 64, 200):
        run = "".join(chr(0x4E00 + i) for i in range(n))
        found = toxicity.passages(run)
        assert all(any(run[i : i + 9] in w for p in found for w in p) for i in range(n - 8))  # nothing is left out
    assert toxicity.passages("a" * 48) == [{"a" * 48}]
    rng = random.Random(6)
    rows = []
    for i in range(300):
        w = say(rng, "en", rng.randint(30, 150)).split()
        if i % 2:
            for _ in range(max(2, len(w) // 30)):
                w[rng.randrange(len(w))] = "scoundrel"
        rows.append((i, " ".join(w), i % 2))
    model = toxicity.fit(rows, 0.2)
    glued = say(rng, "en", 40).split()
    clean, bad = "".join(glued), "".join([*glued[:30], "scoundrel", *glued[30:]])
    assert bad.index("scoundrel") > 48
    p = toxicity.probabilities([clean, bad], model, {})
    assert p[1] > 3 * p[0] and p[0] < 0.5


# ---- media


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 4000, 40_000])
def test_jpeg_round_trip(n):
    data = np.random.default_rng(n).bytes(n)
    media = jpeg.encode(data)
    image = jpeg.decode(media)
    assert jpeg.payload(image) == jpeg.pad(data) and len(jpeg.pad(data)) % 576 == 0
    t = jpeg.rgb(image)
    assert t.dtype == np.uint8 and t.shape == (image.height, image.width, 3)
    assert all(abs(c.coefficients).max() < 2048 for c in image.components.values())


def test_general_decoder_agrees_with_the_bulk_one(monkeypatch):
    media = jpeg.encode(np.random.default_rng(1).bytes(1500))
    fast = jpeg.decode(media)
    monkeypatch.setattr(jpeg, "bulk", lambda *a: False)
    slow = jpeg.decode(media)
    assert all((a.coefficients == b.coefficients).all() for a, b in zip(fast.components.values(), slow.components.values(), strict=True))


def bits_to_bytes(bits):
    bits += "1" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")


def test_decoder_on_a_hand_made_file():
    """Grey, two blocks: variable codes, runs of zeros, end-of-band runs, a refinement that makes new coefficients, 16-bit free."""
    table = lambda kind, lengths, symbols: jpeg.segment(0xC4, bytes([kind, *lengths, *symbols]))
    out = b"\xff\xd8" + jpeg.segment(0xDB, bytes([0] + [2] * 64)) + jpeg.segment(0xC2, bytes([8, 0, 8, 0, 16, 1, 1, 0x11, 0]))
    out += table(0x00, [0, 2] + [0] * 14, [0, 3]) + jpeg.scan_header([1], 0, 0, 0, 1)
    out += bits_to_bytes("01" + "101" + "01" + "010")  # DC differences 5 and -5 (category 3: 010 is -5), shifted by one: 10 and 0
    # AC, high bits: block 1 has at zigzag 3 the value 1 (run 2, size 1), then the end of band for both blocks (EOB1, one bit 0)
    out += table(0x10, [0, 3] + [0] * 14, [0x21, 0x10, 0x01]) + jpeg.scan_header([1], 1, 63, 0, 1)
    out += bits_to_bytes("00" + "1" + "01" + "0")
    # refinement: block 1: a new -1 at zigzag 1 (run 0), then the end of band with the correction 1 of zigzag 3; block 2 empty
    out += table(0x10, [0, 3] + [0] * 14, [0x01, 0x00, 0x11]) + jpeg.scan_header([1], 1, 63, 1, 0)
    out += bits_to_bytes("00" + "0" + "01" + "1" + "01")
    out += jpeg.scan_header([1], 0, 0, 1, 0) + bits_to_bytes("10") + b"\xff\xd9"
    c = jpeg.decode(out).components[1].coefficients.reshape(-1, 64)
    want = np.zeros((2, 64), int)
    want[0, [0, 1, 3]] = 11, -1, 3
    assert (c == want).all()
    grey = jpeg.rgb(jpeg.decode(out))
    k = np.arange(8)
    basis = lambda u: (np.sqrt(1 / 8) if u == 0 else 0.5) * np.cos((2 * k + 1) * u * np.pi / 16)
    block = 128 + sum(2 * v * np.outer(basis(y), basis(x)) for v, y, x in ((11, 0, 0), (-1, 0, 1), (3, 2, 0)))
    assert np.abs(grey[:, :8, 0] - block).max() <= 0.5 and (grey[:, 8:] == 128).all()


def test_chroma_is_repeated_and_converted():
    media = jpeg.encode(b"abc" * 700)
    image = jpeg.decode(media)
    y, cb, cr = jpeg.samples(image)
    assert y.shape == cb.shape == cr.shape and (cb[::2, ::2] == cb[1::2, 1::2]).all()
    r = jpeg.rgb(image).astype(int)
    want = np.clip(np.floor(y + 1.402 * (cr.astype(float) - 128) + 0.5), 0, 255)
    assert np.abs(r[:, :, 0] - want).max() <= 1
    for bad in (b"", b"GIF89a", media[:300], media.replace(b"\xff\xc2", b"\xff\xc0")):
        with pytest.raises((ValueError, IndexError)):
            jpeg.decode(bad)


def test_media_columns(spark):
    rows = [(1, "hello"), (2, None), (3, ""), (4, "é" * 5000), (1, "hello"), (None, "hello")]
    d = frame(spark, rows, "doc_id long, text string")
    got = jpeg.to_media(d, ("media", "height", "width", "rgb", "digests")).collect()
    assert len(got) == len(rows)
    same = [tuple(r)[1:] for r in got if r["doc_id"] in (1, None)]
    assert len(same) == 3 and len(set(map(str, same))) == 1
    for r in got:
        data = (dict(rows)[r["doc_id"]] or "").encode()
        padded = jpeg.pad(data)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
        assert r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest() and r["media_bytes"] == len(r["media"])
        assert len(r["rgb"]) == 3 * r["height"] * r["width"]
    assert jpeg.to_media(d.limit(0), ("digests",)).count() == 0


# ---- queries and the pipeline


def test_each_operator_has_one_query():
    names = list(queries.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_pipeline_stage_by_stage(spark, tmp_path):
    """Each stage's decisions, made again by its operator's own rows on what the stage before kept."""
    import corpus_pipeline as cp
    from plumbline.llm import decontamination, mixing, secrets, simhash
    from plumbline.llm.common import checkpoint_dir, table

    d = "/root/testdata/sf0.001"
    docs = table(spark, d, "documents")
    columns = docs.columns
    kept = {}
    for name, stage in cp.STAGES:
        stage(spark, docs, d).write.parquet(f"{tmp_path}/{name}")
        kept[name] = (docs, spark.read.parquet(f"{tmp_path}/{name}"))
        docs = kept[name][1]
    ids = lambda x: sorted(r[0] for r in x.select("doc_id").collect())
    a, b = kept["quality"]
    assert ids(b) == ids(compression.classify(a, table(spark, d, "labels")).where("predicted = 1")) and b.columns == columns
    a, b = kept["dedup"]
    assert ids(b) == ids(simhash.near_duplicates(a).where("doc_id = component_id")) and b.columns == columns
    a, b = kept["decontamination"]
    leaked = set(ids(decontamination.find_leaks(a, table(spark, d, "benchmark"))))
    assert leaked and ids(b) == [i for i in ids(a) if i not in leaked] and b.columns == columns
    a, b = kept["secrets"]
    assert ids(a) == ids(b) and b.columns == columns
    assert secrets.find_secrets(b).where("n_assign + n_access + n_hex > 0").count() == 0
    a, b = kept["mixing"]
    assert ids(a) == ids(b)
    assert set(columns) <= set(b.columns)
    told = lambda x: sorted(map(str, x.select("doc_id", "text", "lang", "size", "target", "copies", "taken").collect()))
    assert told(b) == told(mixing.mix(a, keep=tuple(columns))) == told(cp.run(spark, d))
    assert [p for p in os.listdir(checkpoint_dir(spark).removeprefix("file:")) if p.startswith("pipeline-")] == []
