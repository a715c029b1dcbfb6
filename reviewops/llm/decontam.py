"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are compared as lower-case words with one space between.
An item of m characters may differ in e = floor(rate * m) edits.  It is cut
into e + 1 pieces; a passage within e edits of it holds at least one piece
unchanged.  An Aho-Corasick automaton finds all pieces of all items in one
run over a text, and each place is verified with Myers' bit-parallel distance.

The benchmark is read in blocks of bounded size, each sent to the tasks once;
the documents are never shuffled.  Whole texts are searched.

An item without words matches nothing.  An item with e = 0 must be found as
whole words.  Null texts are empty, repeated rows each get their rows, empty
tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewops.llm.common import text_of

RATE = 0.08
#: Characters of benchmark text that are sent to the tasks at once.
BLOCK_CHARS = 4_000_000
_WORD = re.compile(r"[^\W_]+")


def normalised(text: str | None) -> str:
    return " ".join(_WORD.findall((text or "").lower()))


def cut(item: str, rate: float = RATE) -> list[tuple[int, str]]:
    """(offset, piece) of the e + 1 pieces, as even as can be."""
    n = int(rate * len(item)) + 1
    at = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(at, at[1:], strict=False)]


def least_distance(pattern: str, text: str) -> int:
    """Smallest edit distance of the pattern to any stretch of the text (Myers' bit-parallel scan)."""
    m = len(pattern)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        if ph & high:
            score += 1
        if mh & high:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        if score < best:
            best = score
    return best


class Matcher:
    """The pieces of a block of items, ready to be searched for."""

    def __init__(self, items: list[tuple], rate: float = RATE):
        import ahocorasick

        self.items, places = [], {}
        for item_id, text in items:
            item = normalised(text)
            if not item:
                continue
            errors = int(rate * len(item))
            self.items.append((item_id, item, errors))
            for at, piece in cut(item, rate) if errors else [(0, f" {item} ")]:
                places.setdefault(piece, []).append((len(self.items) - 1, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()

    def matches(self, text: str | None) -> Iterator[tuple]:
        """(item_id, distance) of the items that the text holds, each once with its least distance."""
        if not self.items:
            return
        body = f" {normalised(text)} "
        starts: dict[int, set[int]] = {}
        for end, (length, where) in self.automaton.iter(body):
            for i, at in where:
                starts.setdefault(i, set()).add(end + 1 - length - at)
        for i, found in starts.items():
            item_id, item, errors = self.items[i]
            if not errors or body.find(item) >= 0:
                yield item_id, 0
                continue
            best, windows = errors + 1, []
            for s in sorted(found):      # places that lie close together are one window
                lo, hi = max(0, s - errors), s + len(item) + errors
                if windows and lo <= windows[-1][1]:
                    windows[-1][1] = hi
                else:
                    windows.append([lo, hi])
            for lo, hi in windows:
                best = min(best, least_distance(item, body[lo:hi]))
            if best <= errors:
                yield item_id, best


def blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", chars: int = BLOCK_CHARS) -> Iterator[list[tuple]]:
    """The items in blocks of about ``chars`` characters, dealt by hash."""
    items = benchmark.select(F.col(item_id).alias("item_id"), text_of(text).alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // chars))
    for b in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        yield [(r[0], r[1]) for r in part.collect()]


def _found(shared):
    def run(batches):
        import pyarrow as pa

        matcher = Matcher(*shared.value)
        for batch in batches:
            out = [(d, *m) for d, t in zip(batch.column("doc_id"), batch.column("text"), strict=True) for m in matcher.matches(t.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array([x[0].as_py() for x in out], batch.schema.field("doc_id").type),
                                              pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64())],
                                             names=["doc_id", "item_id", "distance"])
    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", rate: float = RATE) -> DataFrame:
    """doc_id, item_id, distance for every document and item that it holds within the error budget."""
    sc, rows = docs.sparkSession.sparkContext, docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    schema, out = f"doc_id {dict(rows.dtypes)['doc_id']}, item_id long, distance long", None
    for items in blocks(benchmark):
        part = rows.mapInArrow(_found(sc.broadcast((items, rate))), schema)
        out = part if out is None else out.union(part)
    return out


def _clean(shared, text: str):
    def run(batches):
        import pyarrow as pa

        matcher = Matcher(*shared.value)
        for batch in batches:
            yield batch.filter(pa.array([next(matcher.matches(t.as_py()), None) is None for t in batch.column(text)], pa.bool_()))
    return run


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", rate: float = RATE) -> DataFrame:
    """``docs`` without the rows that hold a test item."""
    sc = docs.sparkSession.sparkContext
    for items in blocks(benchmark):
        docs = docs.mapInArrow(_clean(sc.broadcast((items, rate)), text), docs.schema)
    return docs
