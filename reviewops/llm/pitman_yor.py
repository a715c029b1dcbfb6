"""Language model scoring with a hierarchical Pitman-Yor process.

Every token, a word or the end of its text, is drawn from the restaurant of its
context.  All context restaurants share one parent, the restaurant of single
words, whose parent is the uniform distribution over the V words of the
training texts and one for all others.

* Contexts: the word before; each word that comes before another has a
  restaurant of its own, and the start of a text has one more.  Contexts are
  named by 63 bits of a hash of the word, the start by 0.
* Seating: c customers eat a word in a context.  They sit down one by one, at a
  new table with probability a / (a + i - d t), where a is (strength + d T)
  times the parent's probability of the word, i and t the customers and tables
  of the word so far and T the tables of the restaurant.  Each table is a
  customer of the parent.  After STEP customers, 1 / STEP of those seated sit
  down together and their new tables are the expected number, rounded up or
  down at random.
* Gibbs sampling in blocks: a sweep takes all customers of a word in a context
  away and seats them again, given the tables of all others after the last
  sweep.  Given the restaurants' numbers of tables the words are independent, so
  a sweep is one pass over a table that holds each word with its contexts,
  customers and tables in one place.  Between sweeps the tables are added up by
  context (``told``): buckets send what they hold of a context to its home, a
  range of hashes, and get the restaurant's number of tables back.  Draws are
  hashes of word, context and sweep: reruns agree.
* Scores: after BURN_IN sweeps the predictive probabilities of SAMPLES sweeps
  are averaged.  They sum to 1 over the V words and the one for unknown words.

Words are dealt to buckets by hash, one for each BUCKET bytes of text, and a
bucket's words, counts and tables are packed into arrays that NumPy works on.
Tasks give their counts per bucket, each word once, so a bucket is sent no more
cells than it has tokens.  Words of at least 1 / SPREAD of the tokens, of which
there are at most SPREAD, have too many contexts for one bucket: theirs are
dealt by word and context, and their totals, SPREAD numbers, are added up for
all.  Which words these are is estimated on about SAMPLE bytes of text; any
choice gives the same result.  A sweep carries only what it may change: a
customer who is alone with a word in a context has one table always.

Texts are scored in ROUNDS, where the words are: their words, with context and row, go to
the buckets, and the sums come back by row.  A bucket knows the restaurants
that hold a word of its own; for other contexts, all of them rare, the parent's
probabilities go on to the home of the context.

Null texts count as empty: they have one token, the end.  Every row is a text
of its own, rows with the same id and repeated rows too; null ids count as
empty text in the split.  Without training texts every token has probability 1.
An empty table gives no rows.  Columns other than the id and the text are not
looked at.
"""

from __future__ import annotations

import itertools
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewops.llm.common import WORD_CHARS, forgotten, mix64, text_of, utf8_column, written
from reviewops.llm.words import runs, slices

SPREAD, SAMPLE, BUCKET = 1 << 12, 1 << 24, 1 << 22
STRENGTH, BURN_IN, SAMPLES, STEP = 1.0, 2, 3, 16
#: Names of the start of a text and, for draws, of the parent, as contexts.
START, PARENT = 0, -1
#: The end of a text, as a word.
END = b""
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Tokens that a task holds before it gives them.
TOKENS = 1 << 20
#: Rows with a whole bucket that are read together.
LARGE = 4
#: Texts are scored in so many rounds, by hash, so that the words of one round only are on disk.
ROUNDS = 2
#: Bytes of text that a task looks at together.
TEXT = 1 << 22


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the id as text leaves 2 modulo 7; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 7 == 2


def context(word: bytes) -> int:
    """Restaurant of the tokens that follow a word."""
    return int(contexts([word])[0])


def contexts(words: list[bytes] | np.ndarray) -> np.ndarray:
    from pandas.util import hash_array

    return (hash_array(np.array(words, object), categorize=False) >> np.uint64(1)).astype(np.int64)


# packed arrays -----------------------------------------------------------------------------------------------------------

def blob(values, kind) -> bytes:
    return np.ascontiguousarray(values, kind).tobytes()


def unblob(value: bytes, kind) -> np.ndarray:
    return np.frombuffer(value, kind)


def small(values) -> bytes:
    """Numbers from 0, in as many bytes each as the largest needs; the first byte tells how many.

    First come the lowest bytes of all, then the next ones: most are zeros there, which files and shuffles compress well.
    """
    values = np.asarray(values)
    kind = np.min_scalar_type(int(values.max(initial=0)))
    data = np.ascontiguousarray(values.reshape(-1), kind.newbyteorder("<"))
    return bytes([kind.itemsize]) + data.view(np.uint8).reshape(-1, kind.itemsize).T.tobytes()


def unsmall(value: bytes) -> np.ndarray:
    if not value:
        return np.zeros(0, np.int64)
    data = np.frombuffer(value, np.uint8, offset=1).reshape(value[0], -1)
    return np.ascontiguousarray(data.T).view(f"<u{value[0]}").reshape(-1).astype(np.int64)


def steps(values: np.ndarray) -> bytes:
    """Numbers from 0 in order, as the steps between them."""
    return small(np.diff(values, prepend=0))


def unsteps(value: bytes) -> np.ndarray:
    return np.cumsum(unsmall(value))


def joined(words: list[bytes]) -> bytes:
    """Words hold no blank, so one between them tells them apart."""
    return b" ".join(words)


def one_by_one(table):
    """The rows of an Arrow batch or table, which may be large, as dicts."""
    for i in range(table.num_rows):
        yield table.slice(i, 1).to_pylist()[0]


def listed(table, *names: str):
    """Columns of an Arrow table of many short rows, row by row."""
    return zip(*(table.column(x).to_pylist() for x in names), strict=True)


class Found:
    """Tokens of texts as numbers: what a task holds before it gives counts or cells."""

    def __init__(self):
        self.tokens, self.sizes, self.total = [], [], 0

    def add(self, column) -> None:
        """A text's words, A-Z lower-cased, are followed by one empty string, its end: so it is with a blank behind the last word."""
        import pyarrow as pa
        import pyarrow.compute as pc

        data, offsets = utf8_column(column)
        # from buffers that begin with the first text: on parts of larger ones these functions took other bytes
        text = pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(np.ascontiguousarray(data)))
        text = pc.ascii_trim_whitespace(pc.ascii_lower(text))
        none, blank = pa.scalar("", text.type), pa.scalar(" ", text.type)
        text = pc.if_else(pc.equal(text, none), none, pc.binary_join_element_wise(text, none, blank))
        words = pc.ascii_split_whitespace(text)
        self.tokens.append(words.flatten())
        self.sizes.append(pc.list_value_length(words).to_numpy())
        self.total += len(self.tokens[-1])

    def full(self) -> bool:
        return self.total >= TOKENS

    def numbered(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, word, word before) of each token, words by number; the start of a text comes after all of them."""
        import pyarrow as pa

        coded, sizes = pa.concat_arrays(self.tokens).cast(pa.large_binary()).dictionary_encode(), np.concatenate(self.sizes)
        self.dictionary, ids = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        self.words = self.dictionary.to_numpy(zero_copy_only=False)
        before = np.concatenate((ids[:1], ids[:-1]))
        before[np.cumsum(sizes) - sizes] = len(self.words)
        return np.repeat(np.arange(len(sizes)), sizes), ids, before

    def names(self) -> np.ndarray:
        """The contexts that the words and the start are."""
        return np.append(contexts(self.words), START)

    def by_bucket(self, word: np.ndarray, ctx: np.ndarray, names: np.ndarray, buckets: int, spread: dict):
        """(bucket, its words in order, joined, their sizes, their places) of sorted words, by number, with their contexts."""
        import pyarrow as pa
        import pyarrow.compute as pc

        home = names % buckets
        often = pc.index_in(pa.array(list(spread), self.dictionary.type), value_set=self.dictionary)
        home[often.drop_null().to_numpy()] = -1
        home = home[word]
        dealt = np.flatnonzero(home < 0)
        home[dealt] = (draws(names[word[dealt]], ctx[dealt], -1) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(home.astype(np.min_scalar_type(buckets)), kind="stable")
        home, word = home[order], word[order]
        first = runs(home * len(names) + word)
        sizes, bounds = np.diff(np.append(first, len(word))), np.append(runs(home), len(home))
        cuts = np.searchsorted(first, bounds)
        lists = pa.LargeListArray.from_arrays(pa.array(cuts, pa.int64()), self.dictionary.take(pa.array(word[first])))
        cuts, bounds = cuts.tolist(), bounds.tolist()
        for i, words in enumerate(pc.binary_join(lists, pa.scalar(b" ", self.dictionary.type)).to_pylist()):
            yield int(home[bounds[i]]), words, sizes[cuts[i]:cuts[i + 1]], order[bounds[i]:bounds[i + 1]]


def spread_words(docs: DataFrame, size: int) -> dict[bytes, int]:
    """Numbers of the words, and the end, that are at least 1 / SPREAD of the tokens of about SAMPLE bytes of ``docs``."""
    if size > SAMPLE:
        docs = docs.sample(SAMPLE / size, 12)
    word = F.explode(F.regexp_extract_all(F.translate("text", _UPPER, _UPPER.lower()), F.lit(f"({WORD_CHARS})")))
    counts = written(docs.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n")), "words")
    tokens = counts.agg(F.sum("n")).first()[0] or 0
    found = [r["word"].encode() for r in counts.filter(F.col("n") * SPREAD >= tokens).select("word").collect()]
    forgotten(counts)
    return {w: i for i, w in enumerate([END, *sorted(found)])}


# counts and seating ------------------------------------------------------------------------------------------------------

CELLS = "bucket int, words binary, sizes binary, ctx binary, n binary"


def _cells(buckets: int, spread: dict):
    """Counts of (word, context) of some texts, a row per bucket."""
    def run(batches):
        import pyarrow as pa

        found = Found()

        def given():
            _, word, before = found.numbered()
            names = found.names()
            cell, n = np.unique(word * len(names) + before, return_counts=True)
            word, ctx = cell // len(names), names[cell % len(names)]
            rows = [(b, words, blob(sizes, np.int32), blob(ctx[at], np.int64), small(n[at]))
                    for b, words, sizes, at in found.by_bucket(word, ctx, names, buckets, spread)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], schema=_arrow(CELLS))

        for batch in batches:
            for part in slices(batch, "text", TEXT):
                found.add(part.column("text"))
                if found.full():
                    yield from given()
                    found = Found()
        if found.total:
            yield from given()
    return run


def _arrow(ddl: str, id_type=None):
    import pyarrow as pa

    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "id": id_type}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def merged(table) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, contexts of each, names of all contexts, context's place and count of each cell) of some rows of cells."""
    import pyarrow as pa

    words = [w for x in table.column("words").to_pylist() for w in x.split(b" ")]
    sizes, ctx = (unblob(b"".join(table.column(c).to_pylist()), kind) for c, kind in (("sizes", np.int32), ("ctx", np.int64)))
    n = np.concatenate([unsmall(x) for x in table.column("n").to_pylist()])
    coded = pa.array(words, pa.binary()).dictionary_encode()
    ids, place = np.unique(ctx, return_inverse=True)
    cell = np.repeat(np.asarray(coded.indices).astype(np.int64), sizes) * len(ids) + place
    order = np.argsort(cell)
    cell = cell[order]
    at = runs(cell)
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), np.bincount(cell[at] // len(ids)), ids, cell[at] % len(ids), np.add.reduceat(n[order], at)


#: A bucket: words, their numbers among the spread ones (or -1), how many contexts; names of all its contexts; of each cell its
#: context's place and customers; tables summed over the samples; (n, t) in the parent and tables of the contexts in each sample,
#: customers of the contexts; and for the totals: words, cells and words that have one and two customers, tokens, cells and words
#: without spread ones; customers and contexts of these.
STATE = ("bucket int, words binary, often binary, sizes binary, ids binary, ctx binary, n binary, sums binary, kept binary, levels binary, "
         "guests binary, v long, once long, twice long, alone long, pair long, tokens long, tables long, parents long, "
         "counts array<long>, loads array<long>")
#: What a sweep may change of a bucket.  Words (``warm``) that are spread or have more than one customer: their hashes, numbers among
#: the spread ones, cells of one customer, which have one table always, and cells of more; tables in the parent.  Names of the
#: contexts of these cells and how many cells they have in all buckets; of each cell its context's place, customers and tables; over
#: the samples sums of tables, (n, t) in the parent, and by context the tables here beyond one a cell.  Tables, also of the cells and
#: words left out, and those of spread words.
SEATS = ("bucket int, hashes binary, often binary, single binary, sizes binary, t0 binary, ids binary, cells binary, ctx binary, n binary, "
         "t binary, sums binary, kept binary, beyond binary, others long, strangers long, tables long, parents long, seats array<long>")
KINDS = {"often": np.int32, "sizes": np.int32, "hashes": np.int64}


def part_of(row: dict, *names: str):
    return (unblob(row[x], KINDS[x]) if x in KINDS else unsteps(row[x]) if x == "ids" else unsmall(row[x]) for x in names)


def _table(ddl: str, rows: list[dict]):
    import pyarrow as pa

    schema = _arrow(ddl)
    return pa.table([pa.array([row[f.name] for row in rows], f.type) for f in schema], schema=schema)


def _opening(spread: dict):
    """A bucket's words with their contexts and customers."""
    def run(table):
        words, sizes, ids, ctx, n = merged(table)
        often = np.fromiter((spread.get(w, -1) for w in words), np.int32, len(words))
        own = often < 0
        total = lambda x: _by_number(often, np.add.reduceat(x, np.cumsum(sizes) - sizes), len(spread))
        return _table(STATE, [{
            "bucket": table.column("bucket")[0].as_py(), "words": joined(words), "often": blob(often, np.int32),
            "sizes": blob(sizes, np.int32), "ids": steps(ids), "ctx": small(ctx), "n": small(n),
            "sums": b"", "kept": b"", "levels": b"", "guests": b"", "v": int(own.sum()),
            "once": int((n == 1).sum()), "twice": int((n == 2).sum()), "alone": int((sizes[own] == 1).sum()), "pair": int((sizes[own] == 2).sum()),
            "tokens": int(n.sum()), "tables": len(n), "parents": int(own.sum()), "counts": total(n), "loads": total(np.ones(len(n), np.int64))}])
    return run


def _split(often: np.ndarray, size: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word of each cell, cells of more than one customer, words' numbers of the other cells, words that a sweep looks at)."""
    word = np.repeat(np.arange(len(size)), size)
    crowd = np.flatnonzero(n > 1)
    single = size - np.bincount(word[crowd], minlength=len(size))
    return word, crowd, single, (often >= 0) | (size > 1) | (single < size)


def _first_seats(width: int):
    """The first seating of a bucket: one table for each word in each context."""
    def run(batches):
        for batch in batches:
            for row in one_by_one(batch):
                often, size, ids, ctx, n = part_of(row, "often", "sizes", "ids", "ctx", "n")
                word, crowd, single, warm = _split(often, size, n)
                some, place = np.unique(ctx[crowd], return_inverse=True)
                own, one = often[warm] < 0, np.ones(len(crowd), np.int64)
                hashes = contexts(list(itertools.compress(row["words"].split(b" "), warm.tolist())))
                yield from _table(SEATS, [{
                    "bucket": row["bucket"], "hashes": blob(hashes, np.int64), "often": blob(often[warm], np.int32), "single": small(single[warm]),
                    "sizes": blob((size - single)[warm], np.int32), "t0": small(own.astype(int)), "ids": steps(ids[some]), "cells": b"",
                    "ctx": small(place), "n": small(n[crowd]), "t": small(one), "sums": small(0 * one), "kept": b"", "beyond": b"",
                    "others": len(n) - len(crowd), "strangers": int((~warm).sum()), "tables": len(n), "parents": int((often < 0).sum()),
                    "seats": _by_number(often, size, width)}]).to_batches()
    return run


def _by_number(often: np.ndarray, x: np.ndarray, width: int) -> np.ndarray:
    """x of the words that are spread, by their numbers."""
    out = np.zeros(width, np.int64)
    out[often[often >= 0]] = x[often >= 0]
    return out


# totals by context

SENT, TOLD = "home int, bucket int, asks boolean, ids binary, x binary", "bucket int, home int, x binary"


def homes_of(ids: np.ndarray, homes: int) -> np.ndarray:
    """Contexts have homes by ranges of their 63 bits, so those of sorted contexts are sorted too."""
    return (ids >> 31) * homes >> 32


def _by_home(ids: np.ndarray, homes: int):
    """(home, where its contexts begin, where they end) of sorted contexts."""
    home = homes_of(ids, homes)
    first = runs(home).tolist()
    return zip(home[first].tolist(), first, [*first, len(ids)][1:], strict=True)


def _sent(gives, asks: bool, homes: int):
    """What a bucket holds of each of its contexts, to their homes; it may ask for the totals."""
    def run(batches):
        for batch in batches:
            for row in one_by_one(batch):
                ids, x = unsteps(row["ids"]), gives(row)
                rows = [{"home": home, "bucket": row["bucket"], "asks": asks, "ids": steps(ids[a:b]), "x": small(x[:, a:b])} for home, a, b in _by_home(ids, homes)]
                yield from _table(SENT, rows).to_batches()
    return run


def _summed(table):
    """The totals of a home's contexts, to the buckets that asked for them."""
    import pyarrow as pa

    ids = [unsteps(x) for x in table.column("ids").to_pylist()]
    x = np.concatenate([unsmall(x).reshape(-1, len(i)) for x, i in zip(table.column("x").to_pylist(), ids, strict=True)], 1)
    _, place = np.unique(np.concatenate(ids), return_inverse=True)
    total = np.stack([np.bincount(place, weights=c).astype(np.int64) for c in x])
    asks = table.column("asks")
    parts = [small(total[:, at]) for at, a in zip(np.split(place, np.cumsum([len(i) for i in ids])[:-1]), asks.to_pylist(), strict=True) if a]
    table = table.filter(asks)
    return pa.table([table.column("bucket"), table.column("home"), pa.array(parts, pa.binary())], schema=_arrow(TOLD))


def sent(df: DataFrame, gives, homes: int, *what: str, asks: bool = True) -> DataFrame:
    """Messages of buckets to the homes of their contexts."""
    return df.select("bucket", "ids", *what).mapInArrow(_sent(gives, asks, homes), SENT)


def told(messages: DataFrame) -> DataFrame:
    """For each bucket that asks, the sums over all buckets, by context: a row per home."""
    return messages.groupBy("home").applyInArrow(_summed, TOLD)


def heard(table, width: int) -> np.ndarray:
    """What a bucket was told: a column for each of its contexts, in their order."""
    rows = sorted(zip(table.column("home").to_pylist(), table.column("x").to_pylist(), strict=True))
    return np.concatenate([np.zeros((width, 0), np.int64), *(unsmall(x).reshape(width, -1) for _, x in rows)], 1)


# what buckets give

def _by_context(row: dict, *weights: np.ndarray | None) -> np.ndarray:
    ids, ctx = part_of(row, "ids", "ctx")
    return np.stack([np.bincount(ctx, weights=w, minlength=len(ids)).astype(np.int64) for w in weights])


def _cells_here(row: dict) -> np.ndarray:
    return _by_context(row, None)


def _nothing(row: dict) -> np.ndarray:
    return np.zeros((1, len(unsteps(row["ids"]))), np.int64)


def _beyond(row: dict) -> np.ndarray:
    """Tables beyond one a cell."""
    return _by_context(row, unsmall(row["t"]) - 1)


def _samples_beyond(row: dict) -> np.ndarray:
    beyond = unsmall(row["beyond"]).reshape(SAMPLES, -1)
    return np.append(beyond, np.zeros((1, beyond.shape[1]), np.int64), 0)


def _cells_and_guests(row: dict) -> np.ndarray:
    return _by_context(row, *[None] * SAMPLES, unsmall(row["n"]))


# seating

def draws(word: np.ndarray, ctx: np.ndarray | int, sweep: int) -> np.ndarray:
    """State of the random numbers of a word in a context; word is a 64-bit hash."""
    return mix64(mix64(word) ^ mix64(np.atleast_1d(ctx).astype(np.uint64) * np.uint64(1009) + np.uint64(sweep + 1)))


def seated(c: np.ndarray, a: np.ndarray, p: np.ndarray | float, d: float, state: np.ndarray) -> np.ndarray:
    """Tables after c customers have sat down: the first new table has weight a, each table taken adds d p to it."""
    order = np.argsort(-c, kind="stable")
    c, a, p, state = c[order], a[order], np.broadcast_to(p, c.shape)[order], state[order]
    t = np.minimum(c, 1).astype(np.int64)
    i, n = 1, int(np.searchsorted(-c, -1, "left"))                        # the first n have more customers than i
    while n:
        state = mix64(state[:n] + np.uint64(0x9E3779B97F4A7C15))
        u = (state >> np.uint64(11)) * 2.0 ** -53
        together = np.minimum(max(1, i // STEP), c[:n] - i)
        weight = a[:n] + d * p[:n] * t[:n]
        new = np.floor(together * weight / (weight + i - d * t[:n]) + u).astype(np.int64)
        t[:n] += np.minimum(new, together)
        i += max(1, i // STEP)
        n = int(np.searchsorted(-c[:n], -i, "left"))
    out = np.empty_like(t)
    out[order] = t
    return out


def parent(n: np.ndarray, t: np.ndarray, customers: np.ndarray | int, tables: int, v: int, d: float) -> np.ndarray:
    """Probability of words with n customers and t tables in the parent; n = 0 for unknown words."""
    return (np.maximum(n - d * t, 0) + (STRENGTH + d * tables) / (v + 1)) / (STRENGTH + customers)


def _sweep(level: tuple, v: int, d: tuple[float, float], sweep: int, often_n: np.ndarray, often_t: np.ndarray):
    """Buckets seated again, given the totals after the last sweep, those of the parent's spread words too.

    In samples, tables are added to the sums, and the parent's (n, t) and the contexts' tables to those kept.
    """
    def run(left, right):
        customers, parents = level
        row, tables = next(one_by_one(left)), heard(right, 1)[0]
        if sweep:
            tables = unsmall(row["cells"]) + tables
        else:
            row["cells"] = small(tables)
        hashed, often, single, size, ids, ctx, n, t, t0 = part_of(row, "hashes", "often", "single", "sizes", "ids", "ctx", "n", "t", "t0")
        word, own = np.repeat(np.arange(len(size)), size), often < 0
        n_of = lambda t: single + np.bincount(word, weights=t, minlength=len(size)).astype(np.int64)
        n0, cut = np.where(own, n_of(t), often_n[often]), np.where(own, t0, often_t[often])
        rest = n0[word] - t                                              # customers that other contexts send to the parent
        p = parent(rest, np.minimum(cut[word], rest), customers - t, parents, v, d[0])
        t = seated(n, (STRENGTH + d[1] * (tables[ctx] - t)) * p, p, d[1], draws(hashed[word], ids[ctx], sweep))
        n0 = n_of(t)
        t0 = np.where(own, seated(np.where(own, n0, 0), *_of_parent(t0, parents, v, d), d[0], draws(hashed, PARENT, sweep)), 0)
        row |= {"t": small(t), "t0": small(t0), "tables": int(t.sum()) + row["others"], "parents": int(t0.sum()) + row["strangers"],
                "seats": _by_number(often, n0, len(often_n))}
        if sweep >= BURN_IN:
            row |= {"sums": small(unsmall(row["sums"]) + t), "kept": more(row["kept"], np.where(own, n0, 0), t0), "beyond": more(row["beyond"], _beyond(row)[0])}
        return _table(SEATS, [row])
    return run


def _of_parent(t0: np.ndarray, parents: int, v: int, d: tuple[float, float]) -> tuple[np.ndarray, float]:
    """Weight of a new table in the parent, and the probability of a word there."""
    p = 1 / (v + 1)
    return (STRENGTH + d[0] * (parents - t0)) * p, p


def more(value: bytes, *arrays: np.ndarray) -> bytes:
    return small(np.concatenate((unsmall(value), *arrays)))


#: In place of a home, what else a bucket is told at the end.
SUMS_HERE, KEPT_HERE = -1, -2


def _finished(left, right):
    """What the sweeps left, for all cells, words and contexts of a bucket."""
    row, found = next(one_by_one(left)), dict(listed(right, "home", "x"))
    often, size, n = part_of(row, "often", "sizes", "n")
    _, crowd, _, warm = _split(often, size, n)
    sums, kept = np.full(len(n), SAMPLES), np.ones((SAMPLES, 2, len(size)), np.int64)
    sums[crowd] = unsmall(found[SUMS_HERE])
    kept[:, :, warm] = unsmall(found[KEPT_HERE]).reshape(SAMPLES, 2, -1)
    import pyarrow.compute as pc

    totals = heard(right.filter(pc.greater_equal(right.column("home"), 0)), SAMPLES + 1)
    return _table(STATE, [row | {"sums": small(sums), "kept": small(kept), "levels": small(totals[:SAMPLES]), "guests": small(totals[SAMPLES])}])


@contextmanager
def large_rows(spark: SparkSession):
    """While a bucket is a row, few of them go to a Python worker at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, LARGE)
    try:
        yield
    finally:
        spark.conf.set(key, was)


def by_number(state: DataFrame, what: str, width: int) -> np.ndarray:
    """Sums of an array of ``state``: a number for each spread word."""
    out = np.zeros(width, np.int64)
    for r in state.select(F.posexplode(what).alias("word", "x")).groupBy("word").agg(F.sum("x").alias("x")).collect():
        out[r["word"]] = r["x"]
    return out


def totals(state: DataFrame, *what: str) -> list[int]:
    return [int(x or 0) for x in state.agg(*[F.sum(x) for x in what]).first()]


def discount(once: int, twice: int) -> float:
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5


class Model:
    """What scoring needs: the state (a row per bucket), and numbers of fixed size: counts and, in each sample, (n, t) in the parent of
    the spread words, and (customers, tables) of the parent in each sample."""

    def __init__(self, state: DataFrame, buckets: int, homes: int, spread: dict, tokens: int, v: int, d: tuple[float, float], counts: np.ndarray, kept: list[tuple], samples: list[tuple]):
        self.state, self.buckets, self.homes, self.spread, self.tokens, self.v, self.d = state, buckets, homes, spread, tokens, v, d
        self.counts, self.kept, self.samples = counts, kept, samples

    def numbers(self) -> tuple:
        return self.tokens, self.v, self.d, list(self.spread), self.counts, np.array(self.kept, np.int64), self.samples


def train(docs: DataFrame, text: str = "text") -> Model:
    """Fits the model to all texts of ``docs``."""
    docs = docs.select(text_of(text).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, spread = 1 + size // BUCKET, spread_words(docs, size)
    homes, m = 1 + buckets // 4, len(spread)
    cells = docs.mapInArrow(_cells(buckets, spread), CELLS)
    state = written(cells.groupBy("bucket").applyInArrow(_opening(spread), STATE), "state", LARGE)
    v, once, twice, alone, pair, tokens, tables, parents = totals(state, "v", "once", "twice", "alone", "pair", "tokens", "tables", "parents")
    counts, loads = (by_number(state, x, m) for x in ("counts", "loads"))
    often_n = loads
    often_t = np.minimum(loads, 1)
    v, d = v + int(often_t.sum()), (discount(alone + int((loads == 1).sum()), pair + int((loads == 2).sum())), discount(once, twice))
    level, hashed, kept, samples = (tables, parents + int(often_t.sum())), contexts(list(spread)), [], []

    def next_of(what, last, messages, run, kind):
        with large_rows(docs.sparkSession):
            found = written(last.groupBy("bucket").cogroup(messages.groupBy("bucket")).applyInArrow(run, kind), what, LARGE)
        forgotten(last)
        return found

    with large_rows(docs.sparkSession):
        seats = written(state.select("bucket", "words", "often", "sizes", "ids", "ctx", "n").mapInArrow(_first_seats(m), SEATS), "seats", LARGE)
    messages = sent(state, _cells_here, homes, "ctx", asks=False).unionByName(sent(seats, _nothing, homes))
    for sweep in range(BURN_IN + SAMPLES):
        seats = next_of("seats", seats, told(messages), _sweep(level, v, d, sweep, often_n, often_t), SEATS)
        messages = sent(seats, _beyond, homes, "ctx", "t")
        often_n = by_number(seats, "seats", m)
        often_t = seated(often_n, *_of_parent(often_t, level[1], v, d), d[0], draws(hashed, PARENT, sweep))
        tables, parents = totals(seats, "tables", "parents")
        level = tables, parents + int(often_t.sum())
        if sweep >= BURN_IN:
            samples.append(level)
            kept.append((often_n, often_t))
    messages = sent(state, _cells_and_guests, homes, "ctx", "n").unionByName(sent(seats, _samples_beyond, homes, "beyond", asks=False))
    here = [seats.select("bucket", F.lit(home).alias("home"), F.col(x).alias("x")) for home, x in ((SUMS_HERE, "sums"), (KEPT_HERE, "kept"))]
    state = next_of("state", state, told(messages).unionByName(here[0]).unionByName(here[1]), _finished, STATE)
    forgotten(seats)
    return Model(state, buckets, homes, spread, tokens, v, d, counts, kept, samples)


# scoring -----------------------------------------------------------------------------------------------------------------

class Words:
    """A bucket's words with their averaged predictive probabilities."""

    def __init__(self, row: dict | None, numbers: tuple):
        self.tokens, self.v, d, spread, counts, often_kept, samples = numbers
        self.words = row["words"].split(b" ") if row else []
        row = row or dict.fromkeys(("often", "sizes", "n", "sums", "ctx", "ids", "kept", "levels", "guests"), b"")
        often, size, n, sums, ctx, self.ids, kept, levels, guests = part_of(row, "often", "sizes", "n", "sums", "ctx", "ids", "kept", "levels", "guests")
        kept = kept.reshape(SAMPLES, 2, len(size)).copy()
        kept[:, :, often >= 0] = often_kept[:, :, often[often >= 0]]
        # spread words come here with contexts of which the bucket has no cell, so it knows all of them
        others = np.setdiff1d(np.arange(len(spread)), often)
        self.known, kept = self.words + [spread[i] for i in others.tolist()], np.concatenate((kept, often_kept[:, :, others]), 2)
        # the last word stands for the unknown ones, the last context for those never seen
        self.p0 = np.stack([np.append(parent(k[0], k[1], s[0], s[1], self.v, d[0]), parent(np.zeros(1), np.zeros(1), s[0], s[1], self.v, d[0]))
                            for k, s in zip(kept, samples, strict=True)], 1)
        self.weight = np.append(weights(levels.reshape(SAMPLES, len(guests)), guests, d), np.ones((1, SAMPLES)), 0)
        word = np.repeat(np.arange(len(size)), size)
        c = np.bincount(word, weights=n, minlength=len(size))
        self.c = np.concatenate((np.where(often < 0, c, counts[often]), counts[others], [0]))
        self.cell, self.extra = word * (len(self.ids) + 1) + ctx, (n - d[1] * sums / SAMPLES) / (STRENGTH + guests[ctx])

    def probability(self, word: np.ndarray, ctx: np.ndarray) -> np.ndarray:
        """Of words (by place; -1 if unknown) in contexts; those that this bucket does not know are taken for never seen."""
        return self.probability_at(word, places(ctx, self.ids))

    def probability_at(self, word: np.ndarray, place: np.ndarray) -> np.ndarray:
        p = np.einsum("ij,ij->i", self.p0[word], self.weight[place]) / SAMPLES
        if len(self.cell):
            key = word * (len(self.ids) + 1) + place
            at = np.minimum(np.searchsorted(self.cell, key), len(self.cell) - 1)
            p += np.where((self.cell[at] == key) & (word >= 0) & (place >= 0), self.extra[at], 0)
        return p

    def base(self, word: np.ndarray) -> np.ndarray:
        return np.log10((self.c[word] + 1) / (self.tokens + self.v + 1))


def weights(levels: np.ndarray, guests: np.ndarray, d: tuple[float, float]) -> np.ndarray:
    """Weight of the parent in contexts, a column for each sample."""
    return ((STRENGTH + d[1] * levels) / (STRENGTH + guests)).T


def places(ctx: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Places of contexts among sorted ones, -1 if they are not there."""
    if not len(ids):
        return np.full(len(ctx), -1)
    at = np.minimum(np.searchsorted(ids, ctx), len(ids) - 1)
    return np.where(ids[at] == ctx, at, -1)


#: A text, or, packed, words of a bucket with their contexts, in how many texts of a part they are, these (less the first of their part) and
#: how often.
PART = ("row long, doc_id {id}, held_out boolean, n_tokens long, bucket int, first long, words binary, sizes binary, ctx binary, texts binary, at binary, times binary")
#: A text as above, or, packed, what the words of a bucket add to the texts of a part.
SUMS = "row long, doc_id {id}, held_out boolean, n_tokens long, first long, at binary, known binary, base binary, logs binary"
#: Besides, packed, the parent's probabilities of words in contexts that their bucket does not know, for the contexts' home; the parts of
#: their texts and how many pairs of word and context are of each.
ASKED = SUMS + ", home int, firsts binary, sizes binary, ctx binary, texts binary, times binary, p0 binary"


def _rows(schema, n: int, **columns):
    """An Arrow batch of n rows; columns not given are null."""
    import pyarrow as pa

    given = {name: x if isinstance(x, pa.Array) else pa.array(x, schema.field(name).type) for name, x in columns.items()}
    return pa.RecordBatch.from_arrays([given[f.name] if f.name in given else pa.nulls(n, f.type) for f in schema], schema=schema)


def _packed(buckets: int, spread: dict):
    """A row per text, and a row per bucket with the words of some texts, the part."""
    def run(batches):
        for batch in batches:
            for texts in slices(batch, "text", TEXT):
                yield from given(texts)

    def given(batch):
        found, m, part = Found(), batch.num_rows, _arrow(PART.format(id="id"), batch.schema.field("doc_id").type)
        found.add(batch.column("text"))
        text, word, before = found.numbered()
        row, names = batch.column("row").to_numpy(), found.names()
        yield _rows(part, m, row=batch.column("row"), doc_id=batch.column("doc_id"), held_out=batch.column("held_out"), n_tokens=found.sizes[0],
                    bucket=row % buckets, first=np.full(m, row[0]))
        key, times = np.unique((word * len(names) + before) * m + text, return_counts=True)
        pair, at = key // m, row[key % m] - row[0]
        first = runs(pair)
        texts, pair = np.diff(np.append(first, len(pair))), pair[first]
        word, ctx, rows = pair // len(names), names[pair % len(names)], []
        for b, words, sizes, i in found.by_bucket(word, ctx, names, buckets, spread):
            j = ranges(first[i], texts[i])
            rows.append((b, words, blob(sizes, np.int32), blob(ctx[i], np.int64), small(texts[i]), small(at[j]), small(times[j])))
        yield _rows(part, len(rows), first=np.full(len(rows), row[0]), **dict(zip(("bucket", "words", "sizes", "ctx", "texts", "at", "times"), zip(*rows, strict=True), strict=True)))
    return run


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of runs, one run after the other."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def _scored(numbers: tuple, homes: int):
    """The rows of texts as they are, per part what the words of this bucket add to its texts, and what the homes of contexts are asked."""
    def run(left, right):
        import pyarrow as pa
        import pyarrow.compute as pc

        left = left.combine_chunks()
        schema = _arrow(ASKED.format(id="id"), left.schema.field("doc_id").type)
        texts = left.filter(pc.is_null(left.column("words")))
        plain = ("row", "doc_id", "held_out", "n_tokens", "first")
        out = [pa.table([texts.column(f.name) if f.name in plain else pa.nulls(len(texts), f.type) for f in schema], schema=schema)]
        model = Words(next(one_by_one(right), None), numbers)
        known, names = pa.array(model.known, pa.binary()), ["first", "words", "sizes", "ctx", "texts", "at", "times"]
        packed, pieces, held = left.filter(pc.is_valid(left.column("words"))).select(names), [], 0
        for row in listed(packed, *names):
            pieces.append(row)
            held += len(row[3]) // 8
            if held >= TOKENS:
                out.append(pa.Table.from_pylist(list(added(model, known, pieces)), schema))
                pieces, held = [], 0
        if pieces:
            out.append(pa.Table.from_pylist(list(added(model, known, pieces)), schema))
        return pa.concat_tables(out)

    def added(model, known, pieces):
        """Of some parts."""
        import pyarrow as pa
        import pyarrow.compute as pc

        firsts, words, sizes, ctx, texts, at, times = zip(*pieces, strict=True)
        found = pc.index_in(pa.array([w for x in words for w in x.split(b" ")], pa.binary()), value_set=known)
        found = pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        word = np.repeat(found, np.concatenate([unblob(x, np.int32) for x in sizes]))
        pairs, ctx = [len(x) // 8 for x in ctx], unblob(b"".join(ctx), np.int64)
        texts, at, times = ([unsmall(x) for x in column] for column in (texts, at, times))
        place = places(ctx, model.ids)
        here = place >= 0
        logs, base, c = np.where(here, np.log10(model.probability_at(word, place)), 0), model.base(word), model.c[word] > 0
        end = np.cumsum(pairs).tolist()
        for first, a, b, k, i, x in zip(firsts, [0, *end], end, texts, at, times, strict=False):
            yield _sums(i, x, *(np.repeat(y[a:b], k) for y in (c, base, logs))) | {"first": first}
        away = np.flatnonzero(~here)
        away = away[np.argsort(homes_of(ctx[away], homes), kind="stable")]
        part, texts, at, times = np.repeat(np.arange(len(firsts)), pairs), *(np.concatenate(x) for x in (texts, at, times))
        start = np.cumsum(texts) - texts
        for home, a, b in _by_home(ctx[away], homes):
            i = away[a:b]
            j, own = ranges(start[i], texts[i]), runs(part[i])
            yield {"home": home, "firsts": blob(np.array(firsts)[part[i[own]]], np.int64), "sizes": blob(np.diff(np.append(own, len(i))), np.int32),
                   "ctx": blob(ctx[i], np.int64), "texts": small(texts[i]), "at": small(at[j]), "times": small(times[j]), "p0": blob(model.p0[word[i]], float)}
    return run


def _sums(at: np.ndarray, times: np.ndarray, known: np.ndarray, base: np.ndarray, logs: np.ndarray) -> dict:
    """Sums by text, packed."""
    texts = np.flatnonzero(np.bincount(at))
    total = lambda x: np.bincount(at, weights=x * times)[texts]
    return {"at": small(texts), "known": small(total(known).astype(np.int64)), "base": blob(total(base), float), "logs": blob(total(logs), np.float32)}


#: What a home knows of its contexts, from each bucket.
CONTEXTS = "home int, ids binary, guests binary, levels binary"


def _contexts(homes: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row in one_by_one(batch):
                ids, guests, levels = part_of(row, "ids", "guests", "levels")
                levels = levels.reshape(SAMPLES, -1)
                rows = [(home, steps(ids[a:b]), small(guests[a:b]), small(levels[:, a:b])) for home, a, b in _by_home(ids, homes)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], schema=_arrow(CONTEXTS))
    return run


def _away(d: tuple[float, float], kind: str):
    """What words add to texts whose contexts their buckets do not know."""
    def run(left, right):
        import pyarrow as pa

        schema = _arrow(SUMS.format(id="id"), left.schema.field("doc_id").type)
        if not len(left):
            return schema.empty_table()
        know = list(one_by_one(right))
        if know:
            ids, first = np.unique(np.concatenate([unsteps(r["ids"]) for r in know]), return_index=True)
            guests = np.concatenate([unsmall(r["guests"]) for r in know])[first]
            levels = np.concatenate([unsmall(r["levels"]).reshape(SAMPLES, -1) for r in know], 1)[:, first]
        else:
            ids, guests, levels = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((SAMPLES, 0), np.int64)
        weight = np.append(weights(levels, guests, d), np.ones((1, SAMPLES)), 0)
        firsts, sizes, ctx, texts, at, times, p0 = zip(*listed(left, "firsts", "sizes", "ctx", "texts", "at", "times", "p0"), strict=True)
        p = np.einsum("ij,ij->i", unblob(b"".join(p0), float).reshape(-1, SAMPLES), weight[places(unblob(b"".join(ctx), np.int64), ids)]) / SAMPLES
        texts, at, times = (np.concatenate([unsmall(x) for x in column]) for column in (texts, at, times))
        first = np.repeat(np.repeat(unblob(b"".join(firsts), np.int64), unblob(b"".join(sizes), np.int32)), texts)
        logs, order = np.repeat(np.log10(p), texts), np.argsort(first, kind="stable")
        own, out = runs(first[order]), []
        for i in np.split(order, own[1:]):
            none = np.zeros(len(i))
            out.append(_sums(at[i], times[i], none, none, logs[i]) | {"first": int(first[i[0]])})
        return pa.Table.from_pylist(out, schema)
    return run


def _added(tokens: int):
    """The texts of a part with the sums of all buckets."""
    def run(table):
        import pyarrow as pa
        import pyarrow.compute as pc

        table = table.combine_chunks()
        texts = table.filter(pc.is_null(table.column("at")))
        place = texts.column("row").to_numpy() - texts.column("first").to_numpy()
        order = np.argsort(place)
        size = int(place.max(initial=-1)) + 1
        sums = {x: np.zeros(size) for x in ("n_known", "base_score", "score")}
        for at, known, base, logs in listed(table.filter(pc.is_valid(table.column("at"))), "at", "known", "base", "logs"):
            at = unsmall(at)
            sums["n_known"][at] += unsmall(known)
            sums["base_score"][at] += unblob(base, float)
            sums["score"][at] += unblob(logs, np.float32)
        keep, at = texts.take(pa.array(order)), place[order]
        return pa.table({"doc_id": keep.column("doc_id"), "held_out": keep.column("held_out"), "n_tokens": keep.column("n_tokens"), "n_known": sums["n_known"][at].astype(np.int64),
                         "train_tokens": np.full(len(at), tokens), "base_score": sums["base_score"][at], "score": sums["score"][at]})
    return run


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    numbers = model.numbers()
    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), text_of(text).alias("text"))
    kind, scored = dict(rows.dtypes)["doc_id"], None
    state = model.state.select("bucket", "words", "often", "sizes", "ids", "ctx", "n", "sums", "kept", "levels", "guests")
    known = model.state.select("ids", "guests", "levels").mapInArrow(_contexts(model.homes), CONTEXTS)
    sums, given = SUMS.format(id=kind), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    with large_rows(docs.sparkSession):
        known = written(known, "contexts")
    for i in range(ROUNDS):
        some = rows.filter(F.pmod(F.xxhash64("text"), F.lit(ROUNDS)) == i).withColumn("row", F.monotonically_increasing_id())
        packed = some.mapInArrow(_packed(model.buckets, model.spread), PART.format(id=kind))
        asked = written(packed.groupBy("bucket").cogroup(state.groupBy("bucket")).applyInArrow(_scored(numbers, model.homes), ASKED.format(id=kind)), "sums")
        away = asked.filter("home IS NOT NULL").groupBy("home").cogroup(known.groupBy("home")).applyInArrow(_away(model.d, kind), sums)
        part = written(asked.filter("home IS NULL").select(*away.columns).unionByName(away).groupBy("first").applyInArrow(_added(model.tokens), given), "scores")
        forgotten(asked)
        scored = scored.unionByName(part) if scored is not None else part
    return scored
