import random
import sys
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from test_textvec import regular

from loomcut.llm import textvec, tokenbin

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = [*"abcXYZ  \n\t\r''.,!?-_/0123456789()éèüß×÷«»ñçÄŁő°²½\xa0\xad", "'s", "'ll", "don't", "  ", "\n\n", "<|endoftext|>", "中", "😀", "the ", "'ve", "Straße,"]


def check(coder, texts):
    column, got = pa.array(texts, pa.string()), []
    for _, _, data, offsets in textvec.chunks(column, 1 << 16):
        ids, n = coder.encode(data, offsets)
        got += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
    assert got == [coder.tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]


def drawn(r, most):
    return ["".join(r.choice(PARTS) for _ in range(r.randrange(0, most))) for _ in range(r.randrange(1, 20))]


def test_random_texts():
    coder, r = tokenbin.Encoder(PATH, 0), random.Random(5)
    for _ in range(400):
        check(coder, drawn(r, 60))


@pytest.mark.parametrize("n", [9, 10, 11, 12])
def test_regular_words(n):
    check(tokenbin.Encoder(PATH, 0), list(regular(n)) * 2)


def test_units_that_share_a_hash(monkeypatch):
    hashed = textvec.hash_blocks
    monkeypatch.setattr(textvec, "hash_blocks", lambda *given: (hashed(*given) & np.uint64(31)) + np.uint64(1))
    coder, r = tokenbin.Encoder(PATH, 0), random.Random(6)
    for _ in range(40):
        check(coder, drawn(r, 60))


def test_file_format(spark, tmp_path):
    """Ids in dictionary pages, positions in delta pages, an index of the pages, small row groups."""
    import glob

    import pyarrow.parquet as pq

    r = random.Random(7)
    df = spark.createDataFrame([(i, " ".join(r.choice(["tree", "of", "house", "the"]) for _ in range(200))) for i in range(3000)], "doc_id long, text string").coalesce(1)
    tokenbin.write_tokens(df, str(tmp_path / "t"), PATH, row_group_bytes=1 << 20, page_bytes=64 << 10, page_rows=500)
    metadata = pq.read_metadata(glob.glob(str(tmp_path / "t/*.parquet"))[0])
    for g in range(metadata.num_row_groups):
        columns = {metadata.row_group(g).column(i).path_in_schema: metadata.row_group(g).column(i) for i in range(metadata.num_columns)}
        assert any("DICTIONARY" in e for e in columns["ids.list.element"].encodings)
        for name in ("doc_id", "local_start", "n_tokens"):
            assert columns[name].encodings == ("DELTA_BINARY_PACKED",) and columns[name].has_offset_index and columns[name].has_column_index
    back = spark.read.parquet(str(tmp_path / "t")).where("doc_id between 100 and 120").select("doc_id", "n_tokens")
    assert back.count() == 21 and "doc_id" in back._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1]
