"""Counts on whole texts that the quality operators use."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, encoded

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
ENDS = b".!?"
FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_bang", "n_ends", "n_distinct")
SCHEMA = T.StructType([T.StructField(f, T.LongType()) for f in FIELDS])
ARROW = pa.struct([(f, pa.int64()) for f in FIELDS])


def repeated(words: list[bytes]) -> int:
    """Words that stand in a 3-word window found twice or more in the text."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen, twice = set(), set()
    for w in windows:
        (twice if w in seen else seen).add(w)
    covered, last = 0, -1  # last: end of what is covered so far
    for i, w in enumerate(windows):
        if w in twice:
            covered += i + 3 - max(i, last)
            last = i + 3
    return covered


def stats(text: str | None) -> tuple[int, ...]:
    data = encoded(text)
    words = data.split()
    n = len(data)
    space = n - len(data.translate(None, SPACES))
    seen, dup, lines, ends = set(), 0, 0, 0
    for line in data.split(b"\n"):
        if line.strip():
            lines += 1
            ends += line.rstrip()[-1] in ENDS
            dup += line in seen
            seen.add(line)
    return (
        len(words), len(text or "") - space, n - len(data.translate(None, SYMBOLS)), dup, repeated(words), lines,
        n - len(data.translate(None, UPPER)), n - len(data.translate(None, DIGITS)), data.count(b"!"), ends, len(set(words)),
    )


@F.arrow_udf(SCHEMA)
def text_stats(text: pa.Array) -> pa.Array:
    rows = [stats(t) for t in text.to_pylist()]
    columns = zip(*rows) if rows else [[] for _ in FIELDS]
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], fields=list(ARROW))
