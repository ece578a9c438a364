"""Token output with tokenizers of other kinds than byte-level BPE."""

import pytest
from brute import tokens

from loomcut.llm import common, tokenbin

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_the_library_s(spark, name):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    docs = [(i, t) for i, t in enumerate(["Some plain Words, and more.", "", "  two  spaces\nand a line ", "É über 漢字 😀", "it's 3.5!", None, "<|endoftext|> here", "a" * 3000])]
    out = common.new_path(spark, "kinds")
    tokenbin.write_tokens(spark.createDataFrame(docs, "doc_id long, text string"), out, path)
    got = tokenbin.with_checksum(tokenbin.read_tokens(spark, out)).collect()
    assert sorted(map(tuple, got)) == tokens(docs, Tokenizer.from_file(path))
