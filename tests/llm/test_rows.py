"""Rows that repeat, share an id or have none, and very long ones: what round two's operators do with them."""

import hashlib
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline.llm import chat, decontamination, licenses
from plumbline.llm.common import fold, labelled_texts


def test_a_language_is_learned_from_its_own_rows(spark):
    """Ids with two languages, and with a null one."""
    rows = [(7, "the english text", "en"), (7, "a german text", "de"), (8, "a text without language", None), (8, "the other text", "en"), (9, "zz", "de"), (9, "yy", "de"), (None, "no id", "en"), (10, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = labelled_texts(docs, docs.where("lang is not null"), "lang", 10, 100, own=True)
    assert got == [(7, "a german text", "de"), (7, "the english text", "en"), (8, "the other text", "en"), (9, "yy", "de")]


def test_what_reaches_the_driver_is_bounded_in_characters(spark):
    docs = spark.createDataFrame([(i, "x" * (10 * i), i % 2) for i in range(1, 20)], "doc_id long, text string, y int")
    got = labelled_texts(docs, docs.select("doc_id", "y"), "y", 8, 1000, most_chars=2000)  # 2 labels x 10 ids: of 100 characters at most
    assert got and max(len(t) for _, t, _ in got) == 100
    assert docs.where(fold("doc_id", 3) >= 0).count() == 19


def test_many_turns_take_linear_time(spark):
    n = 64_000
    turns = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("é[<turn "), F.col("id").cast("string")).alias("text"))
    chat.digests(chat.format_conversations(turns.limit(10))).collect()
    start = time.time()
    got = chat.digests(chat.format_conversations(turns)).first()
    took = time.time() - start
    said = [(("user" if k % 3 == 0 else "assistant"), f"é[<turn {k}") for k in range(n)]
    loss = "".join(t for r, t in said if r == "assistant")
    assert got["n_turns"] == n and got["loss_chars"] == len(loss) and got["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert got["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest()
    assert took < 30  # 36 s for a quarter of them when it was quadratic


def test_repeated_items_fill_no_slice(spark, monkeypatch):
    text = "what is the colour of the winter river near the silver garden? it is green as violet stone"
    items = [(1, text)] * 400 + [(2, "name the engine of the carbon market house then say why answer: the signal is light and amber")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(5, f"some words {text} and more of them"), (6, "nothing at all in here"), (5, f"some words {text} and more of them")], "doc_id long, text string")
    one = [tuple(r) for r in decontamination.find_leaks(docs, bench).collect()]
    assert Counter(r[:2] for r in one) == {(5, 1): 2}
    monkeypatch.setattr(decontamination, "MAX_CHARS", 100)
    rows, n = decontamination.dealt(bench)
    assert rows.count() == 2 and n > 1 and rows.groupBy("_s").count().agg(F.max("count")).first()[0] == 1
    assert sorted(map(tuple, decontamination.find_leaks(docs, bench).collect())) == sorted(one)
    assert sorted(r["doc_id"] for r in decontamination.drop_leaks(docs, bench).collect()) == [6]
    monkeypatch.setattr(decontamination, "MAX_CHARS", 40)
    with pytest.raises(ValueError, match="test item"):
        decontamination.find_leaks(docs, bench)


def test_licences_of_repeated_and_nameless_rows(spark):
    notice = "Released under the MIT License."
    rows = [(None, "one two three " + notice), (None, notice + " other words here"), (4, notice), (4, notice), (5, "nothing")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = licenses.find_licenses(docs, {"MIT": notice}).collect()
    assert sorted((str(r["doc_id"]), r["template"], r["first_word"] >= 0, r["windows"] >= 1) for r in got) == [("4", "MIT", True, True)] * 2 + [("None", "MIT", True, True)] * 2
