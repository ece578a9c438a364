import numpy as np
import pytest

from loomcut.llm import textvec


def regular(n):
    """A word over a and b of 2^n letters in which no short block tells much (Thue and Morse), and its complement."""
    x = "a"
    for _ in range(n):
        x += x.translate(str.maketrans("ab", "ba"))
    return x, x.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [9, 10, 11, 12])
def test_regular_words_differ(n):
    data = np.frombuffer(" ".join(regular(n)).encode(), np.uint8)
    hashes = textvec.words(data, np.array([0, len(data)]), textvec.NOT_SPACE).hashes
    assert len(set(hashes.tolist())) == 2


def test_spans():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 5000).astype(np.uint8)
    begins = rng.integers(0, 4900, 4000)
    ends = begins + rng.integers(1, 40, 4000)
    by = {}
    for h, a, b in zip(textvec.hash_spans(data, begins, ends).tolist(), begins, ends):
        by.setdefault(data[a:b].tobytes(), set()).add(h)
    assert all(len(x) == 1 for x in by.values()) and len({h for x in by.values() for h in x}) == len(by)
    assert (textvec.hash_spans(data, begins, ends) != textvec.hash_spans(data, begins, ends, seed=1)).all()
