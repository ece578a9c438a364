from loomcut.operators import cascade


def test_black_border_in_the_cascade(spark):
    assert list(cascade.REGISTRY)[:3] == ["duration_resolution", "black_border", "overexposure"]
    rows = [("none", 20.0, 1000, 500, 0, 0, 0, 9), ("top", 20.0, 1000, 500, 10, 0, 0, 0), ("short", 1.0, 1000, 500, 10, 0, 0, 0), ("tiny", 20.0, 40, 20, 0, 0, 1, 0), ("clean", 20.0, 40, 20, 0, 0, 0, 0), ("null", 20.0, 1000, 500, None, 0, 0, 0)]
    df = spark.createDataFrame(rows, "id string, duration double, width int, height int, border_top int, border_bottom int, border_left int, border_right int")
    got = {r.id: (r.filter_black_border_pass, r.filter_pass) for r in cascade.run(df, ["duration_resolution", "black_border"]).collect()}
    assert got == {"none": (True, True), "top": (False, False), "short": (None, False), "tiny": (False, False), "clean": (True, True), "null": (False, False)}
    wide = cascade.run(df, ["black_border"], {"black_border": {"min_border_fraction": 0.03}}).where("filter_pass").select("id").collect()
    assert sorted(r.id for r in wide) == ["clean", "none", "short", "top"]
