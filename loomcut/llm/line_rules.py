"""Quality rules, line by line first: lines that fail a rule go, then documents that lose too much of their text that way.

A line fails if it holds no end of a sentence (punctuation), if it is a row of short items between separators (navigation), if many of its words
carry signs or run on in marks (noise), or if it is short and says what pages say about themselves (boilerplate). Beside that a text is measured as a whole:
words, their characters, signs, repeated lines and repeated runs of words. Everything is narrow, so nothing is shuffled.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import textvec
from .common import trimmed

#: Words of a window for repeated runs.
WINDOW = 5
LEAST_WORDS, MOST_REPEATED, MOST_LOST = 10, 20, 50

# The rules are patterns of Python and of SQL alike. WORD finds the words of a line, the others what tells against or for one.
WORD = r"[^\x20\x09-\x0D]+"
#: The end of a sentence: a mark, maybe with closing signs, before white space or the end.
SENTENCE = r"[.!?…。！？][\"'”’»)\]]*(?:[\x20\x09-\x0D]|$)"
#: A separator that stands alone.
SEPARATOR = r"(?:^|[\x20\x09-\x0D])(?:[|»›·•→/>]|::|-)(?:[\x20\x09-\x0D]|$)"
#: A word with a sign in it, or with a mark that is repeated at its end.
NOISY = r"[^\x20\x09-\x0D]*(?:[#*$%&|<>]|!!|\?\?)[^\x20\x09-\x0D]*"
#: What pages say about themselves.
BOILERPLATE = (
    r"(?i)\b(?:all rights reserved|terms (?:of (?:use|service)|and conditions)|privacy policy|cookie (?:policy|settings)|(?:uses|accept(?: all)?) cookies|enable javascript|"
    r"javascript is (?:disabled|required)|powered by|sign (?:in|up)|log ?in|skip to (?:main )?content|back to top|read more|click here|subscribe to|share (?:this|on)|lorem ipsum|page not found)\b"
)
#: Beyond so many words a line that holds such a phrase is prose about it.
BOILERPLATE_WORDS = 20
LEAST_SEPARATORS = 3

_WORD, _SENTENCE, _SEPARATOR, _NOISY, _BOILERPLATE = (re.compile(x) for x in (WORD, SENTENCE, SEPARATOR, NOISY, BOILERPLATE))
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
RULES = ("punctuation", "navigation", "noise", "boilerplate")


def failed_rules(line: str, n_words: int) -> list[str]:
    """The rules that a line with words fails."""
    out = []
    if not _SENTENCE.search(line):
        out.append("punctuation")
    separators = len(_SEPARATOR.findall(line))
    if separators >= LEAST_SEPARATORS and 6 * separators >= n_words:
        out.append("navigation")
    if 10 * len(_NOISY.findall(line)) > 3 * n_words:
        out.append("noise")
    if n_words <= BOILERPLATE_WORDS and _BOILERPLATE.search(line):
        out.append("boilerplate")
    return out


def _by_text(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(at, weights=values, minlength=n).astype(np.int64)


def measures(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text. Lines and runs of words are compared by 64 bits of a hash within their text."""
    data, offsets = data[int(offsets[0]) : int(offsets[-1])], (offsets - offsets[0]).astype(np.int64)
    n = len(offsets) - 1
    w = textvec.words(data, offsets, textvec.NOT_SPACE, textvec.AS_IS)
    many = np.diff(w.first)
    owner = np.repeat(np.arange(n), many)
    letters = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    signs = np.append(0, np.cumsum(_SYMBOL[data]))
    # Windows of words that lie in one text, and which of them come again in it.
    grams = textvec.ngrams(w.hashes, WINDOW)
    within = np.flatnonzero(owner[: len(grams)] == owner[WINDOW - 1 :]) if len(grams) else np.zeros(0, np.int64)
    again = within[_repeated(grams[within], owner[within])]
    covered = np.zeros(len(owner) + 1, np.int64)
    np.add.at(covered, again, 1)
    np.add.at(covered, again + WINDOW, -1)
    covered = np.cumsum(covered[:-1]) > 0
    # Lines with words.
    breaks = np.flatnonzero(data == 10)
    begins = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    ends = np.sort(np.concatenate([breaks, offsets[1:]]))
    text = np.searchsorted(offsets, ends, side="left")  # the line of an empty text ends where others begin
    filled = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, begins)
    begins, ends, text = begins[filled], ends[filled], text[filled] - 1
    twice = _repeated(textvec.hash_spans(data, begins, ends), text, first=False)
    return {
        "n_words": many,
        "word_chars": _by_text(letters[w.ends] - letters[w.starts], owner, n),
        "n_symbols": signs[offsets[1:]] - signs[offsets[:-1]],
        "n_dup_lines": np.bincount(text[twice], minlength=n),
        "n_repeat_words": _by_text(covered, owner, n),
    }


def _repeated(hashes: np.ndarray, owner: np.ndarray, first: bool = True) -> np.ndarray:
    """Which hashes come twice or more with the same owner; without the first of each, if not `first`."""
    keys = textvec.mix(hashes + owner.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    if first:
        out[order[:-1][same]] = True
    return out


def clean_lines(docs: DataFrame, text: str = "text", least_words: int = LEAST_WORDS, most_repeated: int = MOST_REPEATED, most_lost: int = MOST_LOST) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lost_words long, lost_rules array<string>, base_failed, kept boolean, and clean_text string.

    clean_text has the text's lines without those that fail a rule; lines without words stay as they are. lost_rules lists the rules by which lines went.
    base_failed: fewer than least_words words, or more than most_repeated of a hundred lie in runs of five words that come again. kept: not
    base_failed, and at most most_lost of a hundred words went with their lines.

    A null text has no words and a null clean_text; an empty one an empty. Whatever the length, a text is judged whole. Repeated rows are judged alike; columns of docs with
    the names of added ones are replaced, others pass through.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lost_words", "lost_rules", "base_failed", "kept", "clean_text"]
    base = [c for c in docs.columns if c.lower() not in added]
    schema = T.StructType([*(docs.schema[c] for c in base), *(T.StructField(c, T.LongType()) for c in added[:6]), T.StructField("lost_rules", T.ArrayType(T.StringType())), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("clean_text", T.StringType())])
    if text not in docs.columns or text not in base:
        raise ValueError(f"docs needs a column {text!r}, other than the added ones")

    def judge(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for a, b, data, offsets in textvec.chunks(batch.column(at).cast(pa.large_string())):
                piece = batch.slice(a, b - a)
                found = measures(data, offsets)
                lost, rules, clean = [], [], []
                for whole in piece.column(at).to_pylist():
                    gone, why, left = 0, set(), []
                    for line in (whole or "").split("\n"):
                        n_words = len(_WORD.findall(line))
                        failed = failed_rules(line, n_words) if n_words else []
                        if failed:
                            gone += n_words
                            why.update(failed)
                        else:
                            left.append(line)
                    lost.append(gone)
                    rules.append(sorted(why))
                    clean.append(None if whole is None else "\n".join(left))
                n_words, n_lost = found["n_words"], np.array(lost, np.int64)
                failed = (n_words < least_words) | (100 * found["n_repeat_words"] > most_repeated * n_words)
                kept = ~failed & (100 * n_lost <= most_lost * n_words)
                columns = [piece.column(piece.schema.get_field_index(c)) for c in base]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(found[c], pa.int64()) for c in added[:5]), pa.array(n_lost), pa.array(rules, pa.list_(pa.string())), pa.array(failed), pa.array(kept), pa.array(clean, pa.string())], [*base, *added])

    return docs.select(*[f"`{c}`" for c in base]).mapInArrow(trimmed(judge), schema)
