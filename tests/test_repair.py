"""Repair of wrongly decoded text: planted texts come back, sound ones stay."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomcut.functions import repair

SOUND = ["", "plain", "Café, naïve, Ærø, straße", "L’été à la plage – « déjà »", "Привет, мир", "Ελληνικά κείμενο", "日本語の文字", "한국어", "emoji 😀 👍🏽", "İstanbul şğı", "żółć", "“quoted” ‘text’ — dash…", "price 5 € or £4 ™", "שלום עולם"]


@pytest.mark.parametrize("text", SOUND)
@pytest.mark.parametrize("times", [1, 2])
@pytest.mark.parametrize("code", ["latin-1", "cp1252"])
def test_planted(text, times, code):
    wrong = text
    for _ in range(times):
        try:
            wrong = wrong.encode().decode(code)
        except UnicodeDecodeError:
            wrong = "".join(bytes([b]).decode(code, "ignore") or chr(b) for b in wrong.encode())
    assert repair.undo_wrong_decoding(wrong) == text


@pytest.mark.parametrize("text", [*SOUND, "CAFÉ»", "PÅ”", "Ã", "Â", "À»", "ÉÉ»", "MÜ®", "Ñ©", "Ø±5", "garçon", "×÷", "Â 5", "ÄÖÜ", "SÃO PAULO", "FAÇADE", "Île-de-France", "naïve café Über"])
def test_sound_stays(text):
    assert repair.undo_wrong_decoding(text) == text


def test_only_the_broken_word_changes():
    assert repair.undo_wrong_decoding("sound é and broken cafÃ© und Ã¼ber\n\tÃ la carte") == "sound é and broken café und über\n\tà la carte".replace("à la", "Ã la")


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=30))
def test_never_raises_and_settles(text):
    once = repair.fix_text(text)
    assert isinstance(once, str) and repair.undo_wrong_decoding(text.encode("ascii", "ignore").decode()) == text.encode("ascii", "ignore").decode()


def test_other_marks():
    assert repair.fix_text("ﬁrst ｗｉｄｅ　“quote” ‘s’\r\nline\rnext\x00\x07﻿ é") == "first wide \"quote\" 's'\nline\nnext é"


def test_columns(spark):
    rows = spark.createDataFrame([(None,), ("",), ("cafÃ©",), ("a\rb",)], "t string")
    assert [r.x for r in rows.select(repair.undone(F.col("t")).alias("x")).collect()] == [None, "", "café", "a\rb"]
    assert [r.x for r in rows.select(repair.fixed(F.col("t")).alias("x")).collect()] == [None, "", "café", "a\nb"]


def test_batches_go_by_slices(spark):
    texts = spark.range(0, 3000, 1, 1).select("id", F.when(F.col("id") % 5 > 0, F.concat(F.lit("cafÃ© "), "id")).alias("t"))
    got = texts.select("id", repair.undone(F.col("t")).alias("x"))
    assert "ArrowEvalPython" in got._jdf.queryExecution().executedPlan().toString() and "pandas" not in repair.__dict__ and "pd" not in repair.__dict__
    assert [r.x for r in got.orderBy("id").collect()] == [f"café {i}" if i % 5 else None for i in range(3000)]
