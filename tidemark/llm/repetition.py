"""Quality rules: how much of a text lies in repeated n-grams and lines.

Every text is read whole, on its own, so nothing is shuffled. Words are hashed from a
rolling polynomial over the bytes, n-grams from one over the word hashes; an n-gram
length is only looked at if the next shorter one repeats (a repeated n-gram holds a
repeated shorter one).

Defined results: a null or empty text has no words, counts of 0, and fails the base rule;
repeated rows, ties and extra columns do not matter, as each row stands alone; an empty
table gives an empty table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from tidemark.llm.frames import append, text_bytes
from tidemark.llm.hashing import as_bytes, cover, repeated, windows_hash, word_hashes, word_spans

BASE_WORDS = 20
BASE_WINDOW = 8
BASE_PERCENT = 30
# Most percent of the word characters that may lie in repeated n-grams, by n, and in
# repeated lines. Labelled documents below these shares are as often good as those
# without any repetition.
NGRAM_PERCENT = {5: 30, 6: 29, 7: 28, 8: 27, 9: 26, 10: 25}
LINE_PERCENT = 30
# Most symbols for a hundred words.
SYMBOL_PERCENT = 10
SCHEMA = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "dup_line_chars bigint, " + ", ".join(f"dup_chars_{n} bigint" for n in NGRAM_PERCENT) + ", "
    "base_failed boolean, kept boolean"
)
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_CHAR = (np.arange(256) & 0xC0) != 0x80


def measure(text: bytes | None) -> tuple:
    """The values of SCHEMA for one text."""
    data = as_bytes(text or b"")
    starts, ends = word_spans(data)
    n = len(starts)
    seen = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_CHAR[data], out=seen[1:])
    chars = seen[ends] - seen[starts]
    words = word_hashes(data, starts, ends)
    dup_lines, dup_line_chars = _lines(data, starts, chars, words)
    dup = dict.fromkeys(NGRAM_PERCENT, 0)
    repeat_words = 0
    for size in sorted(NGRAM_PERCENT):
        grams = windows_hash(words, size)
        twice = repeated(grams) if len(grams) else None
        if twice is None:
            break
        covered = cover(np.flatnonzero(twice), size, n)
        dup[size] = int(chars[covered].sum())
        if size == BASE_WINDOW:
            repeat_words = int(covered.sum())
    total, symbols = int(chars.sum()), int(_SYMBOL[data].sum())
    failed = n < BASE_WORDS or 100 * repeat_words > BASE_PERCENT * n
    kept = (
        not failed
        and all(100 * dup[k] <= most * total for k, most in NGRAM_PERCENT.items())
        and 100 * dup_line_chars <= LINE_PERCENT * total
        and 100 * symbols <= SYMBOL_PERCENT * n
    )
    return n, total, symbols, dup_lines, repeat_words, dup_line_chars, *dup.values(), failed, kept


def _lines(data: np.ndarray, starts: np.ndarray, chars: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    """Lines with a word that equal an earlier one, and the word characters in them."""
    breaks = np.flatnonzero(data == 10)
    if not len(breaks) or not len(starts):
        return 0, 0
    first = np.concatenate([[0], breaks + 1])
    last = np.concatenate([breaks, [len(data)]])
    of = np.searchsorted(first, starts, "right") - 1
    lines, at = np.unique(of, return_index=True)
    hashes = word_hashes(data, first[lines], last[lines])
    _, earliest = np.unique(hashes, return_index=True)
    later = np.ones(len(lines), bool)
    later[earliest] = False
    return int(later.sum()), int(np.add.reduceat(chars, at)[later].sum())


def repetition_coverage(docs: DataFrame) -> DataFrame:
    """doc_id and the measures and verdicts of SCHEMA for each row of docs."""

    def work(batch):
        rows = [measure(text) for text in batch.column("_text").to_pylist()]
        return list(zip(*rows, strict=True)) if rows else [[] for _ in SCHEMA.split(", ")]

    return append(text_bytes(docs, "doc_id"), SCHEMA, lambda: work).drop("_text")
