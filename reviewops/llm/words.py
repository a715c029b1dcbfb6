"""Numbers for the words of texts, so that tasks count with NumPy and not word by word."""

from __future__ import annotations

import re

import numpy as np

from reviewops.llm.common import utf8_column

#: Bytes of one text that are split at once; a longer text is cut at the next separator.
PIECE = 1 << 22
_SEPARATOR = re.compile(rb"[\x20\x09-\x0D]")


class Numbering(dict):
    """A number for each word, by first sight; ``words`` lists them."""

    def __init__(self):
        self.words = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.words)
        self.words.append(word)
        return n

    def clear(self) -> None:
        super().clear()
        self.words = []


def words_of(text: bytes):
    """Lists of the words of a text with A-Z lower-cased; at most about PIECE bytes a list."""
    at = 0
    while len(text) - at > PIECE:
        cut = _SEPARATOR.search(text, at + PIECE)
        if cut is None:
            break
        yield text[at:cut.start()].lower().split()
        at = cut.end()
    yield text[at:].lower().split()


def numbered(column, numbers: Numbering):
    """(index of the text, array of its words' numbers) for each text of an Arrow string column; null counts as empty."""
    data, offsets = utf8_column(column)
    data, bounds = data.tobytes(), offsets.tolist()
    get = numbers.__getitem__
    for i in range(len(bounds) - 1):
        parts = [np.fromiter(map(get, words), np.int64, len(words)) for words in words_of(data[bounds[i]:bounds[i + 1]])]
        yield i, parts[0] if len(parts) == 1 else np.concatenate(parts)


def slices(batch, name: str, size: int):
    """Parts of a batch with at most about ``size`` bytes of text in a column, or a single row."""
    offsets = utf8_column(batch.column(name))[1]
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys starts."""
    return np.flatnonzero(np.concatenate((np.ones(min(1, len(sorted_keys)), bool), sorted_keys[1:] != sorted_keys[:-1])))


def strings(words):
    """Arrow strings of words given as bytes."""
    import pyarrow as pa

    return pa.array(words, pa.binary()).cast(pa.string())
