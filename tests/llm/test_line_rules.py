"""Quality rules by line against plain versions."""

import random
import re
from collections import Counter

import pytest

from loomcut.llm import line_rules, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    lost = sum(len(WORD.findall(x)) for x in lines if line_rules.failed_rules(x, len(WORD.findall(x))))
    failed = n < 10 or 100 * len(covered) > 20 * n
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed, not failed and 2 * lost <= n, lost


def answer(spark, texts):
    df = line_rules.clean_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lost_words").collect()
    return [tuple(r[1:]) for r in sorted(got)]


def test_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op12_quality_rules(spark, SF).collect()
    assert {r.doc_id: tuple(r[1:]) for r in got} == {d: plain(t) for d, t in texts.items()}


def test_odd_texts(spark):
    draw = random.Random(5)
    odd = [None, "", "\n", "\n\n \n", "one", "a\n\na\n", "a\r\na\r\na", "a b c d e a b c d e", "x " * 100_000, "é漢😀 " * 12, "Aa aA " * 9 + ".", "…\n" * 12, "\x0b\x0c\x1f\x85\xa0 x\n"]
    texts = odd + ["".join(draw.choices([*"ab.,!?\n\n  |#é\r\t", "word ", "end. ", " | "], k=draw.randint(0, 80))) for _ in range(400)]
    assert answer(spark, texts) == [plain(t) for t in texts]


@pytest.mark.parametrize(
    "line, rules",
    [
        ("A sentence that ends. And one that", []),
        ("He said “no.”", []),
        ("no end of any sentence here", ["punctuation"]),
        ("Home | News | Sport | All about us and the others.", ["navigation"]),
        ("Home > Shop > Shoes > Sale.", ["navigation", "noise"]),
        ("We read a | b in a long line of prose with only one such sign.", []),
        ("WORD!! WORD!! other WORD.", ["noise"]),
        ("the&&& a$$$ of%%% end.", ["noise"]),
        ("Please enable JavaScript.", ["boilerplate"]),
        ("© 2020 All rights reserved.", ["boilerplate"]),
        ("The court said that all rights reserved by the treaty were kept by those who had held them before the war began.", []),
    ],
)
def test_rules(line, rules):
    assert line_rules.failed_rules(line, len(WORD.findall(line))) == rules


def test_lines_go_and_text_stays(spark):
    text = "Home | News | Sport | Shop\n" + "This is a good line of prose, whole and sound.\n" * 1 + "\n" + "It has another one that ends as well.\nPrivacy policy"
    df = spark.createDataFrame([(1, text, "x", 7)], "id long, text string, kept string, other long")
    row = line_rules.clean_lines(df).first()
    assert row.clean_text == "This is a good line of prose, whole and sound.\n\nIt has another one that ends as well." and row.kept is True and row.other == 7
    assert row.lost_rules == ["boilerplate", "navigation", "noise", "punctuation"] and row.n_lost_words == 9


def test_empty_table(spark):
    assert line_rules.clean_lines(spark.createDataFrame([], "text string")).count() == 0


def test_good_documents_stay_and_bad_ones_go(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    judged = queries.op12_quality_rules(spark, SF).join(labels, "doc_id").where("NOT base_failed").select("quality", "kept").collect()
    good, bad = [r.kept for r in judged if r.quality == 1], [r.kept for r in judged if r.quality == 0]
    assert good and all(good) and sum(bad) <= 0.1 * len(bad)
