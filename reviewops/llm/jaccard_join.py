"""N-gram Jaccard join by a token-group matrix.

Two texts link when their sets of word shingles (4 words) have a Jaccard
similarity of at least ``percent`` / 100.  ``components`` returns one row per
document with the class of equal sets and the component of linked documents.

1. Every text becomes its sorted set of shingle hashes; equal sets are one class.
2. Similar sets overlap in their prefixes: the first n - ceil(t n) + 1 hashes
   in an order that puts frequent shingles last, so a passage that many
   documents share brings no candidates.  Any order gives the same result;
   frequencies only need to be about right (``frequent``).  Prefix hashes are
   range-partitioned; in each run of one hash the smallest document leads, and
   the others are compared with it alone (a star, never all pairs).  Linked
   documents form the groups.
3. The token-group matrix (hash, group) holds, for each group, the union of
   its members' prefixes, and per group a bit image of the union of their
   whole sets.  A document outside a group that shares a column with it is
   bounded: its overlap with any member is at most its bits inside the union.
   Only groups that pass the bound are opened: first a few of their members
   are compared, and where these show no link, all are.
4. Links of all steps give the components.

The comparison is exact; bounds only spare work.  No list of members is ever
gathered in one row or task: hot runs are split by the range partitioning,
opened groups are joined, and the labels come from repeated joins.

Empty or null texts are classes without links.  Repeated rows are kept, null
ids are the largest.  Only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewops.llm.common import forgotten, mix64, row_key, text_of, written
from reviewops.llm.shingles import shingle_sets

WORDS, PERCENT = 4, 85
#: Shingles of at least OFTEN different sets come last in the order; at most MOST of them, the most frequent, are sent to the tasks (8 MB).
OFTEN, MOST = 24, 1 << 20
#: 64-bit words of a set's bit image.
IMAGE = 32
#: Words of the image's fold that every cell of the matrix carries; columns of MANY groups carry the whole image.
FOLD, MANY = 4, 16
BITS = [f"b{i}" for i in range(IMAGE)]


def _repeated(k: int, room: int = 1 << 22):
    """(token, n): shingles that at least two different sets of this task's documents hold, ``room`` shingles at a time."""
    def run(batches):
        import pyarrow as pa

        def given(tokens):
            tokens.sort()
            again = tokens[1:][tokens[1:] == tokens[:-1]]
            token, n = np.unique(again, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n + 1, pa.int64())], names=["token", "n"])

        seen, space, used = set(), np.empty(room, np.uint64), 0
        for batch in batches:
            for s in shingle_sets(batch.column("_t"), k):
                key = (len(s), int(s.sum(dtype=np.uint64)))
                if key in seen:
                    continue
                seen.add(key)
                for a in range(0, len(s), room):
                    part = s[a:a + room]
                    if used + len(part) > room:
                        yield given(space[:used])
                        used = 0
                    space[used:used + len(part)] = part
                    used += len(part)
        yield given(space[:used])

    return run


def frequent(rows: DataFrame, k: int) -> np.ndarray:
    """Sorted hashes of the shingles that many different sets hold.

    Every task counts all its documents and gives what occurs twice among a
    few million shingles; the sums over all tasks decide.  What is spread too
    thin to be seen costs time, never results.
    """
    counts = rows.mapInArrow(_repeated(k), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= OFTEN)
    found = counts.orderBy(F.col("n").desc(), "token").limit(MOST).select("token").toPandas()["token"]
    return np.sort(found.to_numpy(np.int64).view(np.uint64))


def prefix_of(s: np.ndarray, often: np.ndarray, percent: int) -> np.ndarray:
    """The first n - ceil(percent n / 100) + 1 hashes, those in ``often`` last."""
    if not len(s):
        return s
    p = len(s) - (percent * len(s) + 99) // 100 + 1
    for part in (s[:2 * p], s):
        if len(often):
            rare = often[np.minimum(np.searchsorted(often, part), len(often) - 1)] != part
        else:
            rare = np.ones(len(part), bool)
        if rare.sum() >= p:
            return part[rare][:p]
    return np.concatenate((s[rare], s[~rare][:p - rare.sum()]))


def _signatures(k: int, percent: int, shared):
    def run(batches):
        import pyarrow as pa

        often = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            key, n, prefix = [], [], []
            bits = np.zeros((batch.num_rows, IMAGE), np.uint64)
            for i, s in enumerate(shingle_sets(batch.column("_t"), k)):
                n.append(len(s))
                salted = mix64(s ^ np.uint64(0x5BD1E9955BD1E995))
                key.append(np.array([s.sum(dtype=np.uint64), salted.sum(dtype=np.uint64)]).tobytes() + len(s).to_bytes(8, "little"))
                prefix.append(prefix_of(s, often, percent).view(np.int64))
                image = np.zeros(64 * IMAGE, np.uint8)
                image[(s % np.uint64(64 * IMAGE)).astype(np.int64)] = 1
                bits[i] = np.packbits(image, bitorder="little").view(np.uint64)
            ends = np.cumsum([0, *map(len, prefix)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(prefix)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("rk"), pa.array(key, pa.binary()), pa.array(n, pa.int64()), lists,
                 *[pa.array(bits[:, j].copy().view(np.int64)) for j in range(IMAGE)]],
                names=["doc_id", "rk", "key", "n", "prefix", *BITS])
    return run


def _similar(k: int, percent: int):
    """Pairs of texts -> a, b of the pairs that link."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            a, b = shingle_sets(batch.column("ta"), k), shingle_sets(batch.column("tb"), k)
            keep = []
            for x, y in zip(a, b, strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _runs(batches):
    """Rows (token, n, node, pos) sorted by the first three: those of a run of two or more, with the run's first node as leader.

    A run may go on in the next partition, so a partition's first and last
    runs are given whole whatever their length.
    """
    import pyarrow as pa

    def given(token, n, node, pos, first, last):
        start = np.concatenate(([True], token[1:] != token[:-1]))
        run = np.cumsum(start) - 1
        keep = np.bincount(run)[run] > 1
        if first:
            keep |= run == 0
        if last:
            keep |= run == run[-1]
        leader = node[np.flatnonzero(start)][run]
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (token, node, n, pos, leader)], names=["token", "node", "n", "pos", "leader"])

    left, first = None, True
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("token", "n", "node", "pos")]
        cols = [np.concatenate(x) for x in zip(left, cols)] if left else cols
        cut = int(np.searchsorted(cols[0], cols[0][-1], "left"))
        if cut:
            yield given(*[c[:cut] for c in cols], first, False)
            first = False
        elif len(cols[0]) > 200_000:      # one long run: give what there is, its leader goes on
            yield given(*cols, True, True)
            cols = [np.concatenate((c[:1], c[:0])) for c in cols]
        left = [c[cut:] for c in cols]
    if left:
        yield given(*left, first, True)


def _merged(left: DataFrame, right: DataFrame, on: str | Column, how: str = "inner") -> DataFrame:
    """A merge join at any size: a run has dozens of joins of tables that grow with the corpus, and the broadcasts of the
    small ones would all be built and held in the driver.  Joins that spare a shuffle of texts are left to the planner.
    """
    return left.join(right.hint("merge"), on, how)


def _fits(a: Column, b: Column, percent: int) -> Column:
    return (a * 100 >= b * percent) & (b * 100 >= a * percent)


def _outside(of: str, other: str) -> Column:
    """How many bits of one image are not in another."""
    return sum((F.bit_count(F.col(f"{of}{i}").bitwiseAND(F.bitwise_not(f"{other}{i}"))) for i in range(IMAGE)), F.lit(0))


def _images(pairs: DataFrame, classes: DataFrame, on: str, prefix: str) -> DataFrame:
    side = classes.select(F.col("node").alias(on), F.col("n").alias(f"{prefix}n"), *[F.col(b).alias(f"{prefix}{b}") for b in BITS])
    return _merged(pairs, side, on)


def _room(percent: int) -> Column:
    """Whether two images (x, y) leave room for a link."""
    most = F.least(F.col("xn") - _outside("xb", "yb"), F.col("yn") - _outside("yb", "xb"))
    return _fits(F.col("xn"), F.col("yn"), percent) & (most * (100 + percent) >= (F.col("xn") + F.col("yn")) * percent)


def _bounded(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose images leave room for a link."""
    return _images(_images(pairs, classes, "a", "x"), classes, "b", "y").filter(_room(percent)).select("a", "b")


def _members(asked: DataFrame, members: DataFrame, images: DataFrame, percent: int) -> DataFrame:
    """(a, b): the members of opened groups that each document may link with; the bound is part of the join, so no others come out of it."""
    x, y = _images(asked, images, "a", "x"), _images(members.withColumnRenamed("g", "yg"), images, "b", "y")
    return _merged(x, y, (F.col("g") == F.col("yg")) & _room(percent)).select("a", "b")


def _verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs that link, found from their whole texts (one text per class)."""
    side = lambda on, t: texts.select(F.col("node").alias(on), F.col("_t").alias(t))
    both = _merged(_merged(pairs, side("a", "ta"), "a"), side("b", "tb"), "b").select("a", "b", "ta", "tb")
    return both.mapInArrow(_similar(k, percent), "a long, b long")


def _texts(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """One text per needed class (node, rk, again); ``again`` marks rows that the table repeats."""
    found = docs.select("rk", "_t").join(needed, "rk").select("node", "again", "_t")
    once = found.filter("not again").select("node", "_t")
    return written(once.unionByName(found.filter("again").groupBy("node").agg(F.first("_t").alias("_t"))), "texts")


def labels(links: DataFrame) -> DataFrame:
    """(node, label) for the nodes that links name; label is the smallest node reachable.

    Each round every node goes to its smallest neighbour's smallest neighbour
    (or itself), and links are drawn between where their ends went; those
    inside one node go, so links vanish fast.  A stored table ends each round.
    """
    label, edges = None, links.select("a", "b").filter("a != b").distinct()
    while True:
        edges = written(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links", few=True)
        if label is not None and edges.isEmpty():
            return label
        up = edges.groupBy("a").agg(F.min(F.least("a", "b")).alias("up"))
        top = up.select(F.col("a").alias("up"), F.col("up").alias("top"))
        up = written(_merged(up, top, "up").select(F.col("a").alias("from"), F.col("top").alias("to")), "up", few=True)
        if label is None:
            label = up.select(F.col("from").alias("node"), F.col("to").alias("label"))
        else:
            on = _merged(label, up, label["label"] == up["from"], "left")
            label = written(on.select("node", F.coalesce("to", "label").alias("label")), "label", few=True)
        at = lambda c: up.select(F.col("from").alias(c), F.col("to").alias(f"to_{c}"))
        edges = _merged(_merged(edges.filter("a < b"), at("a"), "a"), at("b"), "b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).filter("a != b")


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, rk (key of id and text), n_shingles, class_id, component_id, label.

    ``component_id`` is the smallest id of the component; ids may repeat or be
    null, so ``label`` (a number of this run) is what tells components apart.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), row_key(F.col(doc_id), F.col(text)).alias("rk"), text_of(text).alias("_t"))
    types = dict(rows.dtypes)
    schema = f"doc_id {types['doc_id']}, rk binary, key binary, n long, prefix array<long>, " + ", ".join(f"{b} long" for b in BITS)
    often = docs.sparkSession.sparkContext.broadcast(frequent(rows.select("_t"), k))
    sets = written(rows.mapInArrow(_signatures(k, percent, often), schema), "sets")
    often.destroy()

    # one class per set; ids in the order of the stored files, so they stay as they are
    same = sets.groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rk")).alias("m"),
                                   *[F.first(c).alias(c) for c in ("n", "prefix", *BITS)])
    classes = written(same.select("key", F.col("m.doc_id").alias("class_id"), F.col("m.rk").alias("rk"), "n", "prefix", *BITS)
                      .withColumn("node", F.monotonically_increasing_id()), "classes")

    posts = classes.select(F.posexplode("prefix").alias("pos", "token"), "n", "node")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = written(posts.repartitionByRange(parts, "token", "n", "node").sortWithinPartitions("token", "n", "node")
                   .mapInArrow(_runs, "token long, node long, n long, pos int, leader long"), "runs")

    star = runs.filter("node != leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    star = written(_bounded(star, classes, percent), "star")
    repeated = sets.groupBy("rk").count().filter("count > 1").select("rk", F.lit(True).alias("again"))
    named = written(_merged(classes.select("node", "rk"), repeated, "rk", "left").withColumn("again", F.coalesce("again", F.lit(False))), "named", few=True)
    needed = star.select(F.col("a").alias("node")).union(star.select("b")).distinct()
    texts = _texts(rows, _merged(needed, named, "node"))
    links = written(_verified(star, texts, k, percent), "links")
    forgotten(texts)
    group = labels(links)

    shared = _shared(runs, group)
    forgotten(runs)
    asked = written(_qualified(shared, classes, group, percent), "asked")
    forgotten(shared)
    if not asked.isEmpty():
        inside = _labelled(classes.select("node", "n", *BITS), group).withColumnRenamed("label", "g")
        inside = _merged(inside, asked.select("g").distinct(), "g", "left_semi")
        involved = asked.select(F.col("a").alias("node")).union(inside.select("node")).distinct()
        texts = _texts(rows, _merged(involved, named, "node"))
        members = written(inside.select("g", F.col("node").alias("b")), "members", few=True)
        images = written(_merged(classes.select("node", "n", *BITS), involved, "node", "left_semi"), "images")
        met, turn, most = star, 0, True
        while most:      # a few members of each group first, for one link spares the rest; as long as that settles half
            pairs = written(_unmet(_bounded(_some(asked, members, turn), images, percent), met), "some")
            more = written(_verified(pairs, texts, k, percent), "links")
            links, met, turn = links.unionByName(more), met.unionByName(pairs), turn + 1
            group = labels(links)
            left = written(_apart(asked, group), "asked", few=True)
            most, asked = 2 * left.count() <= asked.count() > 0, left
        opened = written(_unmet(_members(asked, members, images, percent), met), "opened")
        links = written(links.unionByName(_verified(opened, texts, k, percent)), "links")
        forgotten(texts)
        forgotten(images)
        group = labels(links)

    named = _labelled(classes.select("key", "node", "class_id"), group)
    smallest = named.groupBy("label").agg(F.min("class_id").alias("component_id"))
    named = _merged(named, smallest, "label").select("key", "class_id", "component_id", "label")
    out = _merged(sets.select("doc_id", "rk", "key", "n"), named, "key")
    alone = F.col("n") == 0
    return out.select("doc_id", "rk", F.col("n").alias("n_shingles"),
                      F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                      F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "label")


def _labelled(nodes: DataFrame, group: DataFrame) -> DataFrame:
    return _merged(nodes, group, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _shared(cells: DataFrame, group: DataFrame) -> DataFrame:
    """(token, node, n, pos, label) of the tokens that more than one group holds."""
    cells = written(_labelled(cells.select("token", "node", "n", "pos"), group), "cells")
    shared = cells.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("token")
    shared = written(_merged(cells, shared, "token"), "shared")
    forgotten(cells)
    return shared


def _some(asked: DataFrame, members: DataFrame, turn: int) -> DataFrame:
    """(a, b): each opened group's documents asked for, with up to four members; other ones each turn."""
    lot = F.pmod(F.xxhash64("b", F.lit(turn)), F.lit(4))
    few = members.groupBy("g", lot.alias("lot")).agg(F.min(F.struct(F.xxhash64("b", F.lit(turn)).alias("o"), "b")).alias("m"))
    return _merged(asked, few, "g").select("a", F.col("m.b").alias("b"))


def _apart(asked: DataFrame, group: DataFrame) -> DataFrame:
    """Rows whose document and group (named by one of its members) are in different components."""
    la = group.select(F.col("node").alias("a"), F.col("label").alias("la"))
    lg = group.select(F.col("node").alias("g"), F.col("label").alias("lg"))
    both = _merged(_merged(asked, la, "a", "left"), lg, "g", "left")
    return both.filter(F.coalesce("la", "a") != F.coalesce("lg", "g")).select("a", "g")


def _unmet(pairs: DataFrame, met: DataFrame) -> DataFrame:
    """Pairs that have not been compared yet."""
    told = met.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
    return _merged(pairs, told, (F.least("a", "b") == told["lo"]) & (F.greatest("a", "b") == told["hi"]), "left_anti").select("a", "b")


def _sharing(cells: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, g): documents and other groups that share a column and that images folded to ``words`` words cannot rule out.

    Nor the place of the column: prefixes have one order, so what two sets share begins with some column, and from
    there on neither has more hashes than are left in it.  A column that leaves too few to link is not the first they
    share, or they do not link.
    """
    fold = [F.expr(" | ".join(BITS[j::words])).alias(f"f{j}") for j in range(words)]
    cells = _merged(cells, classes.select("node", *fold), "node")
    matrix = cells.groupBy("token", "label").agg(F.min("n").alias("small"), F.max("n").alias("large"), F.max(F.col("n") - F.col("pos")).alias("left"), *[F.bit_or(f"f{j}").alias(f"u{j}") for j in range(words)])
    m = matrix.withColumnRenamed("token", "t").withColumnRenamed("label", "g")
    most = F.col("n") - sum((F.bit_count(F.col(f"f{j}").bitwiseAND(F.bitwise_not(f"u{j}"))) for j in range(words)), F.lit(0))
    most = F.least(most, F.col("n") - F.col("pos"), "left")
    # each pair of groups once: the document's group is the larger label
    asked = _merged(cells, m, (F.col("token") == F.col("t")) & (F.col("label") > F.col("g"))
                       & (F.col("large") * 100 >= F.col("n") * percent) & (F.col("n") * 100 >= F.col("small") * percent)
                       & (most * (100 + percent) * 100 >= (F.col("n") * 100 + F.greatest(F.col("small") * 100, F.col("n") * percent)) * percent))
    return asked.select(F.col("node").alias("a"), "g")


def _qualified(cells: DataFrame, classes: DataFrame, group: DataFrame, percent: int) -> DataFrame:
    """(a, g): documents and other groups that share a column and that the group's union cannot rule out.

    Each cell carries an image into the join, so what cannot link never leaves
    it: a fold of it in most columns, all of it in those of MANY groups or
    more, where a document meets so many that the fold lets too much through.
    """
    wide = written(cells.select("token", "label").distinct().groupBy("token").count().filter(F.col("count") >= MANY).select("token"), "wide", few=True)
    asked = _sharing(cells.join(wide, "token", "left_anti"), classes, FOLD, percent)
    asked = asked.unionByName(_sharing(cells.join(wide, "token", "left_semi"), classes, IMAGE, percent)).distinct()
    # the union of a group's sets as bits
    inside = _merged(_labelled(classes.select("node", "n", *BITS), group), cells.select("label").distinct(), "label", "left_semi")
    unions = inside.groupBy(F.col("label").alias("g")).agg(F.min("n").alias("small"), *[F.bit_or(b).alias(f"u{b}") for b in BITS])
    q = _merged(_images(asked, classes, "a", "x"), unions, "g")
    most = F.col("xn") - _outside("xb", "ub")
    least = F.greatest(F.col("small") * 100, F.col("xn") * percent)       # a fitting member's size, times 100
    return q.filter(most * (100 + percent) * 100 >= (F.col("xn") * 100 + least) * percent).select("a", "g")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` without near duplicates: of each component the document with the smallest id (then key); exact repeats once."""
    found = components(docs, doc_id, text, k, percent).select("rk", "doc_id", "n_shingles", "label")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rk")
    # documents without words are one class but stay alone
    where = F.when(F.col("n_shingles") == 0, F.col("rk"))
    kept = (found.groupBy(where.alias("_alone"), F.when(where.isNull(), F.col("label")).alias("_c"))
            .agg(F.min(order).alias("m")).select(F.col("m.rk").alias("_k")))
    kept = written(kept, "kept", few=True)
    chosen = docs.withColumn("_k", row_key(F.col(doc_id), F.col(text))).join(kept, "_k", "left_semi")
    repeated = written(found.groupBy(F.col("rk").alias("_k")).count().filter("count > 1").select("_k"), "repeats", few=True)
    once = chosen.join(repeated, "_k", "left_anti")
    again = chosen.join(repeated, "_k", "left_semi").dropDuplicates(["_k"])
    return once.unionByName(again).select(*docs.columns)
