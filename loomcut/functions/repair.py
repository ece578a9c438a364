"""Repair of text that was decoded wrongly: UTF-8 that was read as single bytes, found word by word and undone, and the marks that other programs leave."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The bytes 0x80 to 0x9F as Windows shows them, where it does.
_WINDOWS = {bytes([b]).decode("cp1252"): b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
_BYTE = {chr(b): b for b in range(256)} | _WINDOWS
_SHOWN = "".join(map(re.escape, _WINDOWS))
#: A word that may hold the first and a second byte of a character; the no-break space is a byte, so words end at ASCII white space alone.
_SUSPECT = re.compile(rf"[^\x09-\x0d ]*[\xc2-\xf4][\x80-\xbf{_SHOWN}][^\x09-\x0d ]*")
#: First bytes that say enough alone: those of Latin letters with marks, of general punctuation, and of pictures.
_TELLING = set("ÂÃâð")
#: Ranges of what is likely to be meant: Latin, Greek, Cyrillic, Hebrew, Arabic, Devanagari, punctuation and signs, East Asian, pictures.
_LIKELY = [(0xA0, 0x17F), (0x218, 0x21B), (0x300, 0x3FF), (0x400, 0x52F), (0x590, 0x6FF), (0x900, 0x97F), (0xE00, 0xE7F), (0x1E00, 0x1EFF), (0x2010, 0x2044), (0x20AC, 0x20AC), (0x2100, 0x27BF), (0x2B00, 0x2BFF), (0x3000, 0x30FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0xFE0F, 0xFE0F), (0xFEFF, 0xFEFF), (0xFF00, 0xFFEF), (0x1F000, 0x1FAFF)]
_ODD = re.compile("[^\\x00-\\x7f" + "".join(f"{chr(a)}-{chr(b)}" for a, b in _LIKELY) + "]")
_LEADS = re.compile(rf"[\xc2-\xf4](?=[\x80-\xbf{_SHOWN}])")
_WITHIN = re.compile(rf"[\xc2-\xf4](?![^\W_])[\x80-\xbf{_SHOWN}](?=[A-Za-z])")
ROUNDS = 3
_LIGATURES = {ord(c): unicodedata.normalize("NFKD", c) for c in map(chr, range(0xFB00, 0xFB07))}
_WIDE = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)} | {0x3000: 0x20}
_QUOTES = {ord(c): "'" for c in "‘’‚‛"} | {ord(c): '"' for c in "“”„‟"}
_CONTROL = {c: None for c in [*range(0x00, 0x09), 0x0B, *range(0x0E, 0x20), 0x7F, 0xFEFF]}


def _tells(word: str) -> bool:
    """Whether a word's pairs say enough: two of them, one that begins with a telling byte, or one whose second half is a sign that stands before a letter. Else a capital letter before a closing quote may be meant."""
    leads = _LEADS.findall(word)
    return len(leads) > 1 or bool(_TELLING.intersection(leads)) or bool(_WITHIN.search(word))


def _word(match: re.Match) -> str:
    best = now = match[0]
    for _ in range(ROUNDS):
        if not _tells(now):
            break
        try:
            now = bytes(_BYTE[c] for c in now).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            break
        if not _ODD.search(now):
            best = now
    return best


def undo_wrong_decoding(text: str) -> str:
    """text with words that are UTF-8 read as Latin-1 or Windows-1252 put right, up to ROUNDS times over. A word changes only if all of it is valid UTF-8 and comes out as characters that are likely."""
    return _SUSPECT.sub(_word, text)


def fix_text(text: str) -> str:
    """Wrong decoding undone; line ends as \\n; ligatures, wide forms and curly quotes as plain characters; control characters left out; composed characters."""
    text = undo_wrong_decoding(text).replace("\r\n", "\n").replace("\r", "\n")
    return unicodedata.normalize("NFC", text.translate(_LIGATURES).translate(_WIDE).translate(_QUOTES).translate(_CONTROL))


#: Texts of a batch that are Python strings at once.
_SLICE = 256


def _each(work) -> Column:
    def run(texts: pa.Array) -> pa.Array:
        parts = (texts.slice(at, _SLICE).to_pylist() for at in range(0, len(texts), _SLICE))
        done = [pa.array([None if x is None else x if x.isascii() and x.isprintable() else work(x) for x in part], texts.type) for part in parts]
        return pa.concat_arrays(done) if done else texts

    return F.arrow_udf(run, T.StringType())


def undone(text: Column) -> Column:
    """undo_wrong_decoding() of a column; null stays."""
    return _each(undo_wrong_decoding)(text)


def fixed(text: Column) -> Column:
    """fix_text() of a column; null stays."""
    return _each(fix_text)(text)
