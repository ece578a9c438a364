"""Alignment of two tokenizers against a plain version that encodes whole texts."""

import hashlib
import os
import random
from collections import Counter

import pytest

from loomcut.llm import align, queries

public_tokenizers = pytest.importorskip("public_tokenizers")
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


def plain(docs):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    level = {c: n for n, c in enumerate(map(chr, [*range(33, 127), *range(161, 173), *range(174, 256)]))}
    shown = {c: ord(c) for c in level} | {chr(256 + n): x for n, x in enumerate(x for x in range(256) if chr(x) not in level)}
    cut, counts = {}, Counter()
    for doc, text in docs:
        whole, groups, links = f" {text or ''}".encode(), [], []
        ids_a, ids_b = a.encode(f" {text}", add_special_tokens=False).ids if text else [], b.encode(text) if text else []
        as_a = [bytes(shown[c] for c in a.id_to_token(i)) for i in ids_a]
        as_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]]
        if text and b"".join(as_a) == whole == b"".join(as_b):
            ends = [[sum(map(len, x[: i + 1])) for i in range(len(x))] for x in (as_a, as_b)] if len(whole) < 3000 else [_sums(x) for x in (as_a, as_b)]
            at_b = {e: j for j, e in enumerate(ends[1])}
            i0 = j0 = 0
            for i, e in enumerate(ends[0]):
                if e in at_b:
                    j = at_b[e]
                    groups.append(",".join(map(str, ids_a[i0 : i + 1])) + "|" + ",".join(map(str, ids_b[j0 : j + 1])))
                    links.append((ids_a[i], ids_b[j]))
                    i0, j0 = i + 1, j + 1
        else:
            ids_a, ids_b = [], []
        counts.update(links)
        cut[len(cut)] = doc, len(ids_a), len(ids_b), groups, links
    best = {}
    for (_, j), n in counts.items():
        best[j] = max(best.get(j, 0), n)
    out = []
    for doc, n_a, n_b, groups, links in cut.values():
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((doc, n_a, n_b, len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), digest))
    return sorted(out, key=repr)


def _sums(parts):
    out, n = [], 0
    for x in parts:
        n += len(x)
        out.append(n)
    return out


def answer(spark, docs, **more):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return sorted(map(tuple, align.align_documents(df, A, B, **more).collect()), key=repr)


def test_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in queries.op11_token_alignment(spark, SF).collect()), key=repr)
    assert got == plain(docs)


def test_edges(spark):
    odd = ["", None, " ", "\n", " a", "a ", "  a  b  ", "a\r\nb\r\n", "x;\ry", "a▁b", "▁", "</s> <s> <|endoftext|>", "<0x41>\x00", "a\n\n\nb\tc", "é ü 漢字 😀  😀", "x" * 5000, "x y " * 3000, "it's we'll 'tis", "a\xa0b \xa0 c", "a  b　c"]
    docs = [*enumerate(odd), (3, "same"), (3, "same"), (None, "no id"), (None, None)]
    assert answer(spark, docs) == plain(docs)
    assert answer(spark, docs, block_bytes=100) == plain(docs)
    assert answer(spark, []) == []


def test_other_columns_and_groups(spark):
    df = spark.createDataFrame([(1, "a b", 5, "x")], "doc_id long, text string, n_a long, segment string")
    row = align.align_documents(df, A, B, with_groups=True).first()
    assert row.groups_sha256 == hashlib.sha256(row.groups.encode()).hexdigest() and row.groups.count(";") == 1 and row.n_links == 2


def test_segments_are_tokenised_as_in_the_text():
    pair, draw = align.Aligner(A, B), random.Random(3)
    assert set(pair.cuts) == set(" \n\t")  # pieces end in a carriage return after signs
    signs = [*" \n\t\r\x0b\x1c\x85\xa0᠎​ 　﻿ab.,;'s1é漢😀<>|{}\x00(*/", "<|endoftext|>", "</s>", "hello", " the", "\r\n", "  ", "'ll", "́"]
    for _ in range(20_000):
        text = "".join(draw.choices(signs, k=draw.randint(1, 12)))
        segments = pair.segments(text)
        assert "".join(segments) == f" {text}"
        a, b = pair.encode(segments)
        assert sum(a, []) == pair.a.encode(f" {text}", add_special_tokens=False).ids and sum(b, []) == pair.b.encode(text)


def test_byte_alphabet_and_other_kinds():
    from tokenizers import pre_tokenizers

    base = align.Aligner._alphabet(pre_tokenizers)
    assert sorted(base.values()) == list(range(256)) and set(base) == set(pre_tokenizers.ByteLevel.alphabet())
    with pytest.raises(ValueError):
        align.Aligner(public_tokenizers.path("word_bpe_49k.json"), B)


def test_copies_in_one_block_and_many(spark):
    docs = [(i, "the same words in every copy " * 20 + str(i % 3)) for i in range(300)]
    assert answer(spark, docs, block_bytes=2000) == plain(docs)


assert os.path.exists(A) and os.path.exists(B)
