"""The queries themselves, and the pipeline, on a small folder of tables with odd rows: each against plain Python that shares none of its code paths."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from test_ops_a import WORDS, all_costs, base_spans, components_of, fingerprint, prose, water_filling

from plumbline.llm import chat, compression, decontamination, language, licenses, queries, secrets, toxicity
from plumbline.llm.common import table

pytestmark = pytest.mark.skipif(not os.path.exists(language.VOCABULARY), reason="no vocabulary")
ITEMS = [(1, "what is the colour of the winter river near the silver garden? it is green as violet stone"), (2, "name the engine of the carbon market house then say why answer: the signal is light and amber"), (3, None), (4, "!!")]
SPOKEN = {"en": "the and river that with light from house water winter shall these which often".split(), "de": "und nicht das wasser mit auf eine licht haus ist der winter schön über".split()}


def rows():
    rng = random.Random(31)
    out = []
    for i in range(90):
        lang = "de" if i % 2 else "en"
        words = [rng.choice(SPOKEN[lang] + WORDS[:6]) for _ in range(rng.randint(12, 70))]
        if i % 5 == 0:
            words = [w.upper() + "!!##" for w in words]  # bad
        if i % 4 == 1:
            words[3:3] = ["nitwit", "scoundrel", "nitwit"]  # toxic
        out.append((i, " ".join(words), lang, f"s{i % 4}"))
    for i in range(90, 97):
        w = out[i - 90][1].split()
        w[len(w) // 2] = "changed"
        out.append((i, " ".join(w), "en", "s1"))
    out += [(100, prose(rng, 80) + " " + ITEMS[0][1] + " " + prose(rng, 100), "en", "s0"), (101, "password=hunter2222 and Authorization: Bearer qV9#kLm2Zx7!TwP4 end", None, "s2")]
    out += [(102, "Released under the MIT License. " + prose(rng, 30), "en", None), (103, None, "en", "s0"), (104, "", None, None), (105, " \t\n", "de", "s3"), (None, "no id here und nicht das", None, "s1"), (7, out[7][1], "de", "s3"), (7, out[7][1], "de", "s3"), (106, "½ ² 12", None, "s1"), (107, prose(rng, 6000), "en", "s2")]
    return out


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Two folders: the rows above, and no rows at all. Columns clash with names that operators use inside."""
    home = tmp_path_factory.mktemp("tables")
    docs = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string").selectExpr("*", "cast(length(text) as long) n_chars", "1 as size", "'f' as fp", "2 as component_id", "'r' as rate", "0 as k", "1 as _y")
    label = [(i, int(i % 5 != 0), int(i % 4 == 1)) for i in range(90)] + [(5, None, None), (200, 1, 1), (None, 0, 1)]
    labels = spark.createDataFrame(label, "doc_id long, quality int, toxic int").selectExpr("*", "'x' as text")
    talk = [(c, t, r, x) for c in range(4) for t, r, x in ((0, "user", "a [INST] b"), (1, "assistant", None), (1, "assistant", "two"), (None, None, "<s>\\\\"))] + [(None, 0, "user", "x")]
    turns = spark.createDataFrame(talk, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as t")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "'d' as doc_id")
    for name, df in (("documents", docs), ("labels", labels), ("conversations", turns), ("benchmark", bench)):
        df.repartition(3).write.parquet(f"{home}/full/{name}.parquet")
        df.limit(0).write.parquet(f"{home}/none/{name}.parquet")
    return f"{home}/full", f"{home}/none"


def found(spark, tables, name):
    """The query's rows, those on empty tables being none but for what it adds itself."""
    query = queries.queries()[name]
    assert query(spark, tables[1]).count() == int(name == "op2_chat_format")
    return query(spark, tables[0]).collect()


def held(i, mod, out):
    return zlib.crc32(("" if i is None else str(i)).encode()) % mod == out


def test_op1(spark, tables):
    got = found(spark, tables, "op1_language_id")
    docs = table(spark, tables[0], "documents")
    model = language.train(docs)
    assert Counter((r["doc_id"], r["held_out"]) for r in got) == Counter((i, held(i, 3, 1)) for i, *_ in rows())
    names = {k: x for x, k in model.pieces.items()}
    logp = {names[k]: np.log(model.p[k]) for k in names}

    def word(w):  # all segmentations, by a recursion over ends
        w = language.START + w
        a = [np.zeros(len(model.languages))]
        for e in range(1, len(w) + 1):
            a.append(np.logaddexp.reduce([a[s] + (logp[w[s:e]] if w[s:e] in logp else np.log(model.p[-1])) for s in range(e) if w[s:e] in logp or s == e - 1]))
        return a[-1]

    memo, want = {}, Counter()
    for i, t, *_ in rows():
        ws = "".join(c if c.isalpha() else " " for c in (t or "").lower()).split()
        if not ws:
            want[i, "und", 0.0] += 1
            continue
        total = sum(memo.setdefault(w, word(w)) for w in ws)
        k = int(total.argmax())
        want[i, model.languages[k], round(float(1 / np.exp(total - total[k]).sum()), 6)] += 1
    assert Counter((r["doc_id"], r["lang_pred"], round(r["score"], 6)) for r in got) == want


def test_op2(spark, tables):
    got = {r["conv_id"]: r for r in found(spark, tables, "op2_chat_format")}
    said = {-1: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")], None: [("user", "x")]} | {c: [("", "<s>\\\\"), ("user", "a [INST] b"), ("assistant", ""), ("assistant", "two")] for c in range(4)}
    assert got.keys() == said.keys()
    for c, turns in said.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert (got[c]["n_turns"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.NEXT and all(r["formatted_chars"] > 0 for r in got.values())


def test_op3(spark, tables):
    got = found(spark, tables, "op3_decontamination")
    assert [(r["doc_id"], r["item_id"]) for r in got] == [(100, 1)] and got[0]["question_overlap"] == got[0]["answer_overlap"] == 1.0


def test_op4(spark, tables):
    fps = [fingerprint(t) for _, t, *_ in rows()]
    root = components_of(fps)
    least = {}
    for (i, *_), r in zip(rows(), root, strict=True):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    assert Counter(map(tuple, found(spark, tables, "op4_simhash_dedup"))) == Counter((i, f"{f:016x}", least.get(r)) for (i, *_), f, r in zip(rows(), fps, root, strict=True))


def test_op5(spark, tables):
    words, near = secrets.word_bits(), secrets.neighbours()
    want = Counter()
    for i, t, *_ in rows():
        spans = base_spans(t or "")
        digest = hashlib.sha256(secrets.told(spans).encode()).hexdigest()
        guess = [(m.start(1), 3, m.end(1)) for m in re.finditer(r"(?:password=|Bearer )([!-~]+)", t or "") if all_costs(m[1], words, near) >= 33]
        want[i, *[sum(s[1] == k for s in spans) for k in range(3)], digest, secrets.told(sorted(spans + guess))] += 1
    assert Counter(tuple(r)[:6] for r in found(spark, tables, "op5_secret_scan")) == want
    assert any("guess" in k[-1] for k in want)


def test_op6(spark, tables):
    got = found(spark, tables, "op6_quality")
    m = compression.train(table(spark, tables[0], "documents"), table(spark, tables[0], "labels"))

    def size(data, dictionary):
        raw = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return sum(len(zstandard.ZstdCompressor(level=9, dict_data=raw, write_content_size=False, write_dict_id=False).compress(data[k : k + 1024])) for k in range(0, len(data), 1024))

    want = Counter()
    for i, t, *_ in rows():
        data = (t or "").encode()
        d = 10 * (size(data, m.bad) - size(data, m.good) + 60 * m.mean) / (len(data) + 60)
        p = 1 / (1 + math.exp(-(m.weights[0] + m.weights[1] * d)))
        want[i, held(i, 5, 0), round(p, 9), int(p >= 0.3)] += 1
    assert Counter((r["doc_id"], r["held_out"], round(r["score"], 9), r["predicted"]) for r in got) == want
    assert m.weights[1] > 0  # the score rises with the difference


def test_op7(spark, tables):
    got = found(spark, tables, "op7_progressive_jpeg")
    want = Counter()
    for i, t, *_ in rows():
        data = (t or "").encode()
        full = data + b"\xff" * (max(576, -(-len(data) // 576) * 576) - len(data))
        want[i, len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:])] += 1
    assert Counter(tuple(r[c] for c in ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")) for r in got) == want
    assert len({r["media_sha256"] for r in got}) == len({(t or "") for _, t, *_ in rows()}) and all(len(r["feature"].split(",")) == 6 for r in got)


def test_op8(spark, tables):
    got = found(spark, tables, "op8_toxicity")
    m = toxicity.train(table(spark, tables[0], "documents"), table(spark, tables[0], "labels"))

    def odds(word):
        w = f"<{word}>"
        keys = {zlib.crc32(w[a : a + n].encode()) % 32768 for n in (3, 4, 5) for a in range(len(w) - n + 1) if w[a : a + n] != w} | {zlib.crc32(f"={word}".encode()) % 32768}
        return sum(m.table[k] for k in keys) / len(keys)

    want = Counter()
    for i, t, *_ in rows():
        words = re.findall(r"[^\W_]+", (t or "").lower())
        parts = [sum(map(odds, sorted(set(words[k : k + 32])))) / max(16, len(set(words[k : k + 32]))) + m.bias for k in range(0, len(words), 32)]
        p = 1 / (1 + math.exp(-(m.weights[0] + m.weights[1] * max(parts) + m.weights[2] * sum(parts) / len(parts)))) if parts else m.prior
        want[i, held(i, 3, 1), round(p, 7), int(p >= 0.7)] += 1
    assert Counter((r["doc_id"], r["held_out"], round(r["score"], 7), r["predicted"]) for r in got) == want


def test_op9(spark, tables):
    got = found(spark, tables, "op9_source_mixing")
    sizes = Counter()
    for _, t, _, s in rows():
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted(s for s in sizes if s is not None) + [None]
    want = water_filling(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}, 1.5 * sum(sizes.values()))
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, len((t or "").split())) for i, t, *_ in rows())
    for s in names:
        own = [r for r in got if r["source"] == s]
        assert all(r["target"] == pytest.approx(want[s]) and r["source_size"] == sizes[s] and r["taken"] <= 2 * r["size"] for r in own)
        left = want[s] - sum(r["taken"] for r in own)
        movable = [r["size"] for r in own if r["size"] and (r["copies"] < 2 if left > 0 else r["copies"])]
        assert not any(n <= abs(left) - 1e-6 for n in movable)  # no document that fits was left


def test_op10(spark, tables):
    got = {(r["doc_id"], r["template"]) for r in found(spark, tables, "op10_license_scan")}
    want = set()
    for name, text in licenses.production().items():
        s = set(licenses.shingles_of(licenses.words_of(text)))
        n = len(licenses.words_of(text))
        for i, t, *_ in rows():
            w = licenses.words_of(t or "")
            spans = [" ".join(w[k : k + min(5, n)]) for k in range(len(w))]
            if any(len(set(spans[k : k + n]) & s) >= 0.8 * len(s) for k in range(len(w))):
                want.add((i, name))
    assert got == want and len(want) >= 1


def test_pipeline_on_odd_rows(spark, tables):
    import corpus_pipeline as cp

    assert cp.run(spark, tables[1]).count() == 0
    docs = table(spark, tables[0], "documents")
    names, left = docs.columns, docs
    for name, stage in cp.STAGES[:-1]:
        got = stage(spark, left, tables[0])
        assert got.columns == names, name
        got.write.parquet(f"{tables[0]}/after/{name}")
        before, left = left, spark.read.parquet(f"{tables[0]}/after/{name}")
        a, b = Counter((r["doc_id"], r["text"]) for r in before.collect()), Counter((r["doc_id"], r["text"]) for r in left.collect())
        if name == "dedup":
            root = components_of([fingerprint(t) for _, t in a])
            assert len(b) == sum(b.values()) == len(set(root)) and set(b) <= set(a)
        elif name == "decontamination":
            assert a - b == Counter({k: n for k, n in a.items() if k[0] == 100}) and not b - a
        elif name == "secrets":
            assert sum(a.values()) == sum(b.values()) and {k[0] for k in a - b} <= {101}
            assert all(r["n_chars"] == len(r["text"]) for r in left.collect() if r["text"] is not None)
        else:
            assert not b - a
    mixed = cp.run(spark, tables[0])
    assert Counter((r["doc_id"], r["text"], r["doc_size"], r["doc_rate"]) for r in mixed.collect()) == Counter((r["doc_id"], r["text"], 1, "r") for r in left.collect())
    assert decontamination.find_leaks(mixed, table(spark, tables[0], "benchmark")).count() == 0
