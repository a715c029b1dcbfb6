"""Spelling variant grouping by blocked Gram matrices.

Words one inserted, deleted or replaced code point apart are near; a word much
rarer than a near one is taken for its variant.

1. Words are counted over all texts.
2. A word's letter counts are a vector.  One replacement changes two counts by
   one (squared distance 2), one insertion one count (squared distance 1), so
   near words are at most 2 apart and of the same or the next length.
3. Blocks: the letters are dealt to a few groups of about equal weight, and a
   word's block is its length with its number of letters of each group.  Near
   words lie in the same block or in blocks that differ by one letter taken
   from a group and/or one put into a group.  Every word stays in its own block
   and visits the neighbouring ones on one side, so each pair meets once.
4. In a block the products of the count matrices (NumPy) give all squared
   distances; pairs at most 2 apart are verified letter by letter.  A task
   gives per word the number of its near words and the best of them, not pairs.

There are more groups, so smaller blocks, the more words there are; the result
does not depend on it.  A block with more words than a task should hold is cut
by hash: its pieces meet the visitors and one another piece by piece, so no
block is too large and no pair is lost.

Null texts have no words, a null id counts as empty text.  Rows with the same
id are texts of their own; repeated rows count again.  An empty table gives no
rows.  Columns other than the id and the text are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewops.llm.common import text_of, written

LETTERS = "a-zÀ-ÿ"
MIN_LENGTH, MIN_COUNT, RATIO, NOISE = 7, 2, 10, 31
#: Words of a block in one task, visitors for each of them, and letters of a block in one task.
BLOCK, VISITORS, CHARS = 2048, 8, 1 << 24
#: Entries of one product, and letters of pairs verified at once.
ENTRIES, VERIFIED = 1 << 22, 1 << 24
NEAR = "word string, n_near long, best_n long, best string"


def noisy_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): runs of letters, one code point lost where NOISE divides the hash of id and run; at least MIN_LENGTH long and MIN_COUNT times."""
    lowered = F.translate(text_of(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    # runs that are too short now are too short later
    run = F.explode(F.regexp_extract_all(lowered, F.lit(f"[{LETTERS}]{{{MIN_LENGTH},}}"), 0))
    runs = docs.select(text_of(F.col(doc_id).cast("string")).alias("id"), run.alias("run"))
    h, size = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")), F.length("run")
    at = (h % size).cast("int")
    less = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    word = F.when(h % NOISE == 0, less).otherwise(F.col("run"))
    return runs.select(word.alias("word")).filter(F.length("word") >= MIN_LENGTH).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_COUNT)


def letter_groups(words: DataFrame) -> list[str]:
    """The letters that occur, dealt to groups of about equal weight; more groups for more words."""
    found = words.select(F.explode(F.split("word", "")).alias("letter")).groupBy("letter").agg(F.count("*").alias("n")).collect()
    groups = [""] * min(8, 2 + int(math.log2(words.count() + 2)) // 6)
    load = [0] * len(groups)
    for r in sorted(found, key=lambda r: (-r["n"], r["letter"])):
        g = load.index(min(load))
        groups[g] += r["letter"]
        load[g] += r["n"]
    return groups


def _key(counts: list[Column]) -> Column:
    """Counts side by side in one long; counts over 255 share a block."""
    return sum((F.shiftleft(F.least(c, F.lit(255)).cast("long"), 8 * i) for i, c in enumerate(counts)), F.lit(0).cast("long"))


def visits(words: DataFrame, groups: list[str]) -> DataFrame:
    """(size, block, home, word, n): every word in its own block and as a visitor in the neighbours on one side."""
    counts = [F.col(f"c{i}") for i in range(len(groups))]
    rows = words.select("word", "n", F.length("word").alias("len"), *[(F.length("word") - F.length(F.translate("word", g, ""))).alias(f"c{i}") for i, g in enumerate(groups)])

    def moved(*changes: tuple[int, int]) -> list[Column]:
        return [c + sum(by for g, by in changes if g == i) for i, c in enumerate(counts)]

    def place(size: Column, at: list[Column], home: bool) -> Column:
        return F.struct(size.alias("size"), _key(at).alias("block"), F.lit(home).alias("home"))

    size = F.col("len")
    places = [place(size, counts, True)]
    for a in range(len(counts)):
        places.append(F.when(counts[a] > 0, place(size - 1, moved((a, -1)), False)))
        places += [F.when(counts[a] > 0, place(size, moved((a, -1), (b, 1)), False)) for b in range(a)]
    return rows.select("word", "n", F.explode(F.array_compact(F.array(*places))).alias("at")).select("at.*", "word", "n")


def dealt(rows: DataFrame) -> DataFrame:
    """``visits`` with (piece, slot): a block's own words in pieces, its visitors in slots, each piece with each slot.

    A word of piece i also visits the pieces before its own.
    """
    cap = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.lit(CHARS) / F.col("size")).cast("long"))
    own, all_ = F.sum(F.col("home").cast("long")), F.count("*")
    large = rows.groupBy("size", "block").agg(own.alias("own"), all_.alias("rows")).select(
        "size", "block", F.ceil(F.col("own") / cap).cast("int").alias("pieces"), F.ceil(F.col("rows") / (cap * VISITORS)).cast("int").alias("slots"))
    large = large.filter("pieces > 1 or (slots > 1 and pieces > 0)")
    rows = rows.join(large, ["size", "block"], "left").na.fill(1, ["pieces", "slots"])
    piece, slot = F.pmod(F.xxhash64("word"), F.col("pieces")).cast("int"), F.pmod(F.xxhash64("word", F.lit(1)), F.col("slots")).cast("int")

    def each(n: Column, make) -> Column:
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), make)).otherwise(F.array())

    at = lambda piece, slot, home: F.struct(piece.alias("piece"), slot.alias("slot"), F.lit(home).alias("own"))
    stays = F.concat(each(F.col("slots"), lambda s: at(piece, s, True)), each(piece, lambda p: at(p, slot, False)))
    comes = each(F.col("pieces"), lambda p: at(p, slot, False))
    return rows.select("size", "block", "word", "n", F.explode(F.when(F.col("home"), stays).otherwise(comes)).alias("to")).select("size", "block", "to.*", "word", "n")


def letters_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(code points padded with 0, counts of the code points that occur) of Latin-1 words, a row each."""
    sizes = np.array([len(w) for w in words])
    flat, row = np.frombuffer(b"".join(words), np.uint8), np.repeat(np.arange(len(words)), sizes)
    padded = np.zeros((len(words), int(sizes.max(initial=0))), np.uint8)
    padded[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    used, code = np.unique(flat, return_inverse=True)
    counts = np.bincount(row * max(1, len(used)) + code, minlength=len(words) * len(used)).reshape(len(words), len(used))
    return padded, counts.astype(np.float32 if padded.shape[1] < 2000 else np.float64)


def one_edit(a: np.ndarray, b: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """Whether the padded words of a and b differ by one replacement or, where b is longer, by one letter more."""
    out = np.zeros(len(a), bool)
    same = np.flatnonzero(~longer)
    out[same] = (a[same] != b[same]).sum(1) == 1
    more = np.flatnonzero(longer)
    a, b = a[more], b[more]
    size = np.count_nonzero(a, axis=1)
    before = (a != b).argmax(1)                                      # they differ at the latest where a ends
    shifted = np.concatenate((b[:, 1:], np.zeros((len(b), 1), np.uint8)), 1) != a
    after = np.where(shifted.any(1), size - a.shape[1] + shifted[:, ::-1].argmax(1), size)
    out[more] = before + after >= size
    return out


def near_pairs(words: list[bytes], own: np.ndarray, within: bool) -> tuple[np.ndarray, np.ndarray]:
    """Indices of near words: those with ``own`` against the visitors and, if ``within``, one another.  Visitors may be one letter longer."""
    padded, counts = letters_of(words)
    size, norm = np.count_nonzero(padded, axis=1), (counts * counts).sum(1)
    home, rest = np.flatnonzero(own), np.flatnonzero(~own)
    others = np.concatenate((home, rest)) if within else rest
    step, found = max(1, ENTRIES // max(1, len(home))), []
    for lo in range(0, len(others), step):
        at = others[lo:lo + step]
        square = norm[home][:, None] + norm[at] - 2 * (counts[home] @ counts[at].T)
        i, j = np.nonzero(square <= 2)
        i, j = home[i], at[j]
        good = (~own[j] | (i < j)) & (size[j] >= size[i])
        i, j = i[good], j[good]
        pairs = max(1, VERIFIED // max(1, padded.shape[1]))
        for k in range(0, len(i), pairs):
            a, b = i[k:k + pairs], j[k:k + pairs]
            near = one_edit(padded[a], padded[b], size[b] > size[a])
            found.append((a[near], b[near]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def _near(frame):
    """Per word of one piece and slot: number of near words met here, and the best of them."""
    import pandas as pd

    words = [w.encode("latin-1") for w in frame["word"]]
    own = frame["own"].to_numpy(bool)
    a, b = near_pairs(words, own, int(frame["slot"].iloc[0]) == 0)
    n, rank = frame["n"].to_numpy(np.int64), np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    of, other = np.concatenate((a, b)), np.concatenate((b, a))
    order = np.lexsort((rank[other], -n[other], of))
    of, other = of[order], other[order]
    at = np.flatnonzero(np.diff(of, prepend=-1))
    names = frame["word"].to_numpy()
    return pd.DataFrame({"word": names[of[at]], "n_near": np.diff(np.append(at, len(of))), "best_n": n[other[at]], "best": names[other[at]]})


def near_words(words: DataFrame, groups: list[str]) -> DataFrame:
    """(word, n_near, best_n, best) of the words that have near words; best has the largest n, then comes first in code-point order."""
    met = dealt(visits(words, groups)).groupBy("size", "block", "piece", "slot").applyInPandas(_near, NEAR)
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return met.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): forms followed to the last.  A form is RATIO times as frequent, so chains are short; each round doubles the steps."""
    found = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = found.select(F.col("word").alias("root"), F.col("root").alias("last"))
        if found.join(onward, "root", "left_semi").isEmpty():
            return found
        found = written(found.join(onward, "root", "left").select("word", F.coalesce("last", "root").alias("root")), "roots")


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    words = written(noisy_words(docs, doc_id, text), "words")
    near = near_words(words, letter_groups(words))
    usual = F.col("best_n") >= RATIO * F.col("n")
    rows = written(words.join(near, "word", "left").select(
        "word", F.when(usual, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(usual, F.col("best_n")).alias("form_n")), "near")
    last = roots(rows.filter("form is not null"))
    return rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
