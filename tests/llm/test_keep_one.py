from loomcut.llm import ngram_join


def test_rows_that_share_an_id_but_not_a_text(spark):
    a, b, c = ("one two three four five six seven", "red green blue black white grey pink", "a whole other text of seven words")
    df = spark.createDataFrame([(5, a, 1), (5, a, 2), (5, b, 3), (7, b, 4), (8, c, 5), (8, a, 6), (9, "", 7), (9, None, 8), (9, c, 9), (None, c, 10)], "doc_id long, text string, at long")
    kept = sorted((str(r.doc_id), r.text or "") for r in ngram_join.keep_one(df).collect())
    assert kept == sorted([("5", a), ("5", b), ("8", c), ("9", ""), ("None", c)])
