import json

from loomcut.llm import chatfmt, queries


def test_layouts_with_further_fields(spark):
    turn = {"role": "user", "content": "hi"}
    recs = [
        {"messages": [turn | {"metadata": {"a": [{"b": 1}]}}], "id": 1}, {"prompt": "p", "response": "r", "source": "s"}, {"system": "s", "prompt": "p", "response": "r", "id": 3},
        {"conversations": [{"from": "human", "value": "q", "weight": 1}]}, [turn | {"m": {"q": [1]}}], {"b.c: x": {"question": 1}, "answer": "a"}, {"question": {}, "answer": ["a"]}, {"turn": 1, "role": None, "text": "t", "conv_id": 9, "x y": 2},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(recs)], "i int, record string")
    got = {r.i: (r.layout, [tuple(t) for t in r.turns]) for r in chatfmt.normalize(df).collect()}
    assert got[0] == ("messages", [("user", "hi")]) and got[4] == ("turn-list", [("user", "hi")])
    assert got[1] == ("prompt-response", [("user", "p"), ("assistant", "r")])
    assert got[2] == ("system-prompt-response", [("system", "s"), ("user", "p"), ("assistant", "r")])
    assert got[3] == ("conversations", [("user", "q")])
    assert got[5] == (None, []) and got[6] == ("question-answer", [("user", "{}"), ("assistant", '["a"]')])
    assert got[7] == ("rows-by-turn", [(None, "t")])
    assert [tuple(r) for r in chatfmt.record_rows(df).collect()] == [(9, 1, None, "t")]


def test_paths_as_of_a_schema(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([('{"a": [{"b": {"c": [1], "d": null}}], "e": 1.5}',)], "record string")
    kind = df.select(F.from_json("record", "a array<struct<b struct<c array<int>, d string>>>, e double")).schema[0].dataType
    assert sorted(df.select(chatfmt.json_paths(F.parse_json("record"))).first()[0]) == chatfmt.field_paths(kind)


def test_query_goes_through_the_mapping(spark, monkeypatch):
    other = tuple(m for m in chatfmt.MAPPINGS if m.name != "rows-by-turn")
    rows = chatfmt.record_rows
    want = queries.op9_chat_format(spark, "/root/testdata/sf0.001").count()
    assert want > 1
    monkeypatch.setattr(chatfmt, "record_rows", lambda records: rows(records, mappings=other))
    assert queries.op9_chat_format(spark, "/root/testdata/sf0.001").count() == 0
