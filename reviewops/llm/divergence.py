r"""Source divergence audit by chunk factorization.

For every language the term frequencies of its sources are held against one
another and against the language as a whole.

1. A task counts the white-space chunks of each document and adds them up by
   (lang, source, chunk): occurrences, documents, and the least and greatest
   document among them.
2. The counts meet by chunk.  Each chunk of the whole corpus is split into terms
   once, and its terms take over its counts; white space separates terms, so no
   term is cut.  A task adds them up by (lang, source, term) before they move on.
3. Occurrences add up.  Three documents at one place settle that a term is kept;
   fewer are all named (least and greatest), and the different ones are counted.
4. A kept term's share p in a group of count n is
   ``1 + floor(10^9 (n + 1) / (N + V))``, and ``f = floor((p - q)^2 / q)``.
5. ``pair``: f summed over all kept terms.  p depends on the count alone and
   most counts are 0, so the sum is taken over a histogram of counts, and only
   terms found in both sources are looked at one by one (per task with NumPy,
   added up by pair of sources, never written out as pairs of rows).

Null text, lang and source count as ''.  Every row is a document of its own,
rows with the same id and repeated rows too.  Documents without terms still
make their group occur.  An empty table gives no rows.  Ties go to the item
smaller in UTF-8 order.  Columns other than text, lang and source are not
looked at.  All arithmetic is exact while a language has fewer than 9 * 10^18
occurrences.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewops.llm.common import text_of, written
from reviewops.llm.words import Numbering, numbered, runs, strings

_TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCALE, MIN_DOCS, TOP = 10 ** 9, 3, 200
#: Words, and different words, that a task counts before it gives its counts.
WORDS, DIFFERENT = 3 << 20, 3 << 18
#: Counts of chunks that a task adds up at once.
ROWS = 1 << 18
#: Sums of pairs of sources that a task holds before it gives them.
PAIRS = 1 << 20


def _chunk_counts(batches):
    """(lang, source, chunk, n, docs, lo, hi) of some documents; lo and hi are the least and greatest row number."""
    import pyarrow as pa

    numbers, groups = Numbering(), {}
    ids, rows, of, total = [], [], [], 0

    def given():
        doc = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
        width = max(1, len(numbers))
        key, n = np.unique(doc * width + np.concatenate(ids), return_counts=True)
        doc, word = key // width, key % width
        key = np.array(of, np.int64)[doc] * width + word
        order = np.argsort(key, kind="stable")
        key, n, row = key[order], n[order], np.array(rows, np.int64)[doc[order]]
        at = runs(key)
        if not len(at):
            return
        lang, source = (pa.array(x, pa.string()) for x in zip(*groups, strict=True))
        group = pa.array(key[at] // width)
        yield pa.RecordBatch.from_arrays(
            [lang.take(group), source.take(group), strings(numbers.words).take(pa.array(key[at] % width)), pa.array(np.add.reduceat(n, at)),
             pa.array(np.diff(np.append(at, len(key)))), pa.array(np.minimum.reduceat(row, at)), pa.array(np.maximum.reduceat(row, at))],
            names=["lang", "source", "chunk", "n", "docs", "lo", "hi"])

    for batch in batches:
        keys = list(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True))
        row = batch.column("row").to_pylist()
        for i, found in numbered(batch.column("text"), numbers):
            ids.append(found)
            rows.append(row[i])
            of.append(groups.setdefault(keys[i], len(groups)))
            total += len(found) + 1
            if total >= WORDS or len(numbers) >= DIFFERENT:
                yield from given()
                numbers.clear()
                groups.clear()
                ids, rows, of, total = [], [], [], 0
    if ids:
        yield from given()


CHUNKS = "lang string, source string, chunk string, n long, docs long, lo long, hi long"
TERMS = "lang string, source string, term string, n long, docs long, lo long, hi long"


def _terms(batches):
    """(lang, source, term, n, docs, lo, hi) of counts with equal chunks side by side: each chunk is split once, then added up by term.

    Up to two documents are lo and hi; with three or more docs is MIN_DOCS and they do not matter.
    """
    import pyarrow as pa

    held, rows = [], 0

    def given(table):
        chunk = table.column("chunk").combine_chunks().dictionary_encode()
        names = Numbering()
        terms = [[names[t] for t in _TERM.findall(x)] for x in chunk.dictionary.to_pylist()]
        size = np.array([len(t) for t in terms], np.int64)
        flat, first = np.array([t for x in terms for t in x], np.int64), np.cumsum(size) - size
        code = np.asarray(chunk.indices)
        row = np.repeat(np.arange(len(code)), size[code])
        term = flat[np.arange(len(row)) - np.repeat(np.cumsum(size[code]) - size[code] - first[code], size[code])]
        if not len(row):
            return
        lang, source = (table.column(c).combine_chunks().dictionary_encode() for c in ("lang", "source"))
        kinds, width = len(source.dictionary), len(names)
        group = np.asarray(lang.indices).astype(np.int64) * kinds + np.asarray(source.indices)
        n, docs, lo, hi = (table.column(c).to_numpy() for c in ("n", "docs", "lo", "hi"))
        key = group[row] * width + term
        keys, at = np.unique(key, return_inverse=True)
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, at, n[row])
        many = np.bincount(at, weights=docs[row] >= MIN_DOCS, minlength=len(keys)) > 0
        # the different documents of each term
        few = ~many[at]
        of, doc = np.tile(at[few], 2), np.concatenate((lo[row[few]], hi[row[few]]))
        order = np.lexsort((doc, of))
        of, doc = of[order], doc[order]
        new = np.concatenate((np.ones(min(1, len(of)), bool), (of[1:] != of[:-1]) | (doc[1:] != doc[:-1])))
        of, doc = of[new], doc[new]
        seen = np.bincount(of, minlength=len(keys))
        least, most = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        least[of[::-1]], most[of] = doc[::-1], doc
        yield pa.RecordBatch.from_arrays(
            [lang.dictionary.take(pa.array(keys // width // kinds)), source.dictionary.take(pa.array(keys // width % kinds)), pa.array(names.words, pa.string()).take(pa.array(keys % width)),
             pa.array(total), pa.array(np.where(many, MIN_DOCS, np.minimum(seen, MIN_DOCS))), pa.array(least), pa.array(most)], names=[x.split()[0] for x in TERMS.split(", ")])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= ROWS:
            # all but the last chunk, which may go on (unless there is no other)
            table = pa.Table.from_batches(held)
            chunk, cut = table.column("chunk"), table.num_rows - 1
            while cut and chunk[cut - 1] == chunk[-1]:
                cut -= 1
            cut = cut or table.num_rows
            yield from given(table.slice(0, cut))
            held = table.slice(cut).to_batches()
            rows = sum(x.num_rows for x in held)
    if held:
        yield from given(pa.Table.from_batches(held))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of columns lang, source, text without nulls: occurrences, and documents up to MIN_DOCS (or more)."""
    chunks = docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_chunk_counts, CHUNKS)
    # sorted by a hash, which is cheaper; two chunks of one hash may be split once more, which changes no sum
    terms = chunks.repartition("chunk").sortWithinPartitions(F.xxhash64("chunk")).mapInArrow(_terms, TERMS).repartition("lang", "term")
    lo, hi, none = F.col("lo"), F.col("hi"), F.lit(None).cast("long")
    who = F.when(F.col("docs") >= MIN_DOCS, F.array(none)).when(F.col("docs") > 1, F.array(lo, hi)).otherwise(F.array(lo))
    each = terms.select("lang", "source", "term", "n", F.posexplode(who).alias("i", "doc"))
    return (each.groupBy("lang", "source", "term", "doc").agg(F.sum(F.when(F.col("i") == 0, F.col("n")).otherwise(0)).alias("n"))
            .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc").isNull(), MIN_DOCS).otherwise(1)).alias("docs")))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share(n: Column, total: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / total), without overflow."""
    wide = _div(F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)"), total.cast("decimal(20,0)"))
    return 1 + F.when(n < 9 * 10 ** 9, _div(F.lit(SCALE).cast("long") * (n + 1), total)).otherwise(wide)


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); shares are at most 10^9 + 1."""
    return _div((p - q) * (p - q), q)


def _pair_sums(batches):
    """(lang, source, item, value): per pair of sources, over terms found in both, f less what it is with either count 0.

    Rows come sorted by lang and term.  A term's rows meet those one, two, ... places further on; the last term of a
    batch waits for the next one.
    """
    import pyarrow as pa

    def f(p, q):
        return (p - q) * (p - q) // q

    names, sums, left = {}, {}, None

    def given():
        pairs = np.array(list(sums), np.int64).reshape(-1, 2)
        groups = list(names)
        lang, source = (pa.array([g[k] for g in groups], pa.string()) for k in (0, 1))
        a, b = pa.array(pairs[:, 0]), pa.array(pairs[:, 1])
        return pa.RecordBatch.from_arrays([lang.take(a), source.take(a), source.take(b), pa.array(list(sums.values()), pa.int64())],
                                          names=["lang", "source", "item", "value"])

    def added(table):
        lang, term, source = (table.column(c).combine_chunks().dictionary_encode() for c in ("lang", "term", "source"))
        p, zero = (table.column(c).to_numpy() for c in ("p", "zero"))
        codes = [np.asarray(x.indices) for x in (lang, term, source)]
        kinds = codes[0] * np.int64(len(source.dictionary)) + codes[2]
        here, inverse = np.unique(kinds, return_inverse=True)
        langs, sources = lang.dictionary.to_pylist(), source.dictionary.to_pylist()
        group = np.array([names.setdefault((langs[k // len(sources)], sources[k % len(sources)]), len(names)) for k in here.tolist()], np.int64)[inverse]
        at = np.arange(len(p))
        for step in range(1, len(p)):
            at = at[at + step < len(p)]
            at = at[(codes[1][at] == codes[1][at + step]) & (codes[0][at] == codes[0][at + step])]
            if not len(at):
                break
            for a, b in ((at, at + step), (at + step, at)):
                value = f(p[a], p[b]) - f(p[a], zero[b]) - f(zero[a], p[b]) + f(zero[a], zero[b])
                key = group[a] * len(names) + group[b]
                order = np.argsort(key, kind="stable")
                start = runs(key[order])
                for k, v in zip(key[order][start].tolist(), np.add.reduceat(value[order], start).tolist(), strict=True):
                    pair = divmod(k, len(names))
                    sums[pair] = sums.get(pair, 0) + v

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch] if left is None else [*left.to_batches(), batch])
        last = table.slice(table.num_rows - 1)
        lang, term = last.column("lang")[0], last.column("term")[0]
        cut = table.num_rows - 1
        while cut and table.column("term")[cut - 1] == term and table.column("lang")[cut - 1] == lang:
            cut -= 1
        if cut:
            added(table.slice(0, cut))
        left = table.slice(cut)
        if len(sums) > PAIRS:
            yield given()
            names.clear()
            sums.clear()
    if left is not None:
        added(left)
        yield given()


def divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank of every group: all pairs, and its TOP terms more frequent than in the language."""
    docs = docs.select(text_of(F.col(lang)).alias("lang"), text_of(F.col(source)).alias("source"), text_of(text).alias("text"))
    counts = term_counts(docs)
    total = Window.partitionBy("lang", "term")
    kept = written(counts.withColumn("docs", F.sum("docs").over(total)).withColumn("lang_n", F.sum("n").over(total))
                   .filter(F.col("docs") >= MIN_DOCS).select("lang", "source", "term", "n", "lang_n"), "kept")
    size = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    kinds = kept.groupBy("lang", "term").agg(F.first("lang_n").alias("n")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_total"))
    groups = written(docs.select("lang", "source").distinct().join(size, ["lang", "source"], "left").join(kinds, "lang", "left")
                     .na.fill(0, ["total", "v", "lang_total"])
                     .withColumn("zero", F.when(F.col("v") > 0, share(F.lit(0).cast("long"), F.col("total") + F.col("v")))), "groups")
    found = kept.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total") + F.col("v")))

    other = groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("other"))
    # all counts 0, then what a count above 0 on one side changes, then what it changes on both
    base = groups.join(other, "lang").filter("source <> item").select(
        "lang", "source", "item", F.coalesce(F.col("v") * distance(F.col("zero"), F.col("other")), F.lit(0)).cast("long").alias("value"))
    levels = written(found.groupBy("lang", "source", "p", "zero").agg(F.count("*").alias("times")), "levels").join(other, "lang").filter("source <> item")
    p, zero, q, times = (F.col(c) for c in ("p", "zero", "other", "times"))
    one = levels.groupBy("lang", "source", "item").agg(F.sum(times * (distance(p, q) - distance(zero, q))).alias("value"),
                                                       F.sum(times * (distance(q, p) - distance(q, zero))).alias("back"))
    both = found.select("lang", "term", "source", "p", "zero").repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(
        _pair_sums, "lang string, source string, item string, value long")
    sums = base.unionByName(one.select("lang", "source", "item", "value")).unionByName(
        one.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("back").alias("value"))).unionByName(both)
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))

    q = share(F.col("lang_n"), F.col("lang_total") + F.col("v"))
    terms = found.withColumn("q", q).filter("p > q").select("lang", "source", F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"),
                                                            F.lit("term").alias("part"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    ranked = terms.withColumn("rank", rank).filter(F.col("rank") <= TOP)
    return pairs.withColumn("rank", rank).unionByName(ranked).select("lang", "source", "part", "item", "value", "rank")
