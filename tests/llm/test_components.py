import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute

from loomcut.llm import common


@pytest.mark.parametrize("hub", [common.HUB, 20, 2])
def test_against_union_find(spark, monkeypatch, hub):
    monkeypatch.setattr(common, "HUB", hub)
    r = random.Random(hub)
    edges = [(i, 0) for i in range(1, 60)] + [(100 + i, 101 + i) for i in range(40)] + [(r.randrange(200, 400), r.randrange(200, 400)) for _ in range(150)] + [(500, 500), (None, 7), (59, 300)]
    edges += [(600, i) for i in range(601, 640)]
    got = {x.node: x.root for x in common.components(spark.createDataFrame(edges, "u long, v long").repartition(3)).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == brute.roots({x for e in real for x in e}, real)


def test_no_edges(spark):
    assert common.components(spark.createDataFrame([], "u long, v long")).count() == 0
