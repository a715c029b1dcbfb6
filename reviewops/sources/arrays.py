"""JSON array files read by several tasks each (A1).

Spark's text source splits a file at any separator, here at ``}``, so a task
gets a byte range cut to whole pieces that each end where an object may end.
What a piece means depends on all bytes before it: whether it begins inside a
string, and how deep.  Two passes settle that without reading a file in one task:

1. each range is summed up for both cases, outside and inside a string: whether
   the case changes over it and by how much the depth does (one row a range);
2. running sums over the ranges of a file give the true state at the start of
   each, and each range is cut into the objects of the outer array.  Objects
   that go over the end of a range are put together from their parts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewops.sources.tables import stored

QUOTE, BACKSLASH, OPEN, CLOSE, LIST, END = (ord(c) for c in '"\\{}[]')


def structure(data: np.ndarray, inside: bool) -> tuple[np.ndarray, bool]:
    """(depth change at each byte, whether the text ends inside a string) of JSON text that begins inside or outside a string."""
    place = np.arange(len(data))
    plain = np.maximum.accumulate(np.where(data == BACKSLASH, -1, place))          # the last byte that is no backslash
    before = np.concatenate((np.full(1, -1), plain[:-1]))
    quote = (data == QUOTE) & ((place - 1 - before) % 2 == 0)
    within = (np.cumsum(quote) + inside) % 2 == 1
    step = np.isin(data, (OPEN, LIST)).astype(np.int8) - np.isin(data, (CLOSE, END)).astype(np.int8)
    step[within] = 0
    return step, bool(within[-1]) if len(data) else inside


class Range:
    """Cuts the text of one range, given in parts, into the elements of the outer array."""

    def __init__(self, inside: bool, depth: int):
        self.inside, self.depth, self.done = inside, depth, 0
        # of the element that is open: its text so far, its place, whether it began in this range
        self.held, self.place, self.mine = ([b""], 0, False) if depth > 1 else (None, 0, False)

    def feed(self, text: bytes) -> list[tuple[int, str, bytes]]:
        """(place, part, text) of what ends here; part is 'whole', or 'head' if it began in an earlier range."""
        data, out = np.frombuffer(text, np.uint8), []
        step, self.inside = structure(data, self.inside)
        depth = self.depth + np.cumsum(step, dtype=np.int64)
        self.depth = int(depth[-1]) if len(depth) else self.depth
        starts = np.flatnonzero((step == 1) & (depth == 2)).tolist()
        ends = (np.flatnonzero((step == -1) & (depth == 1)) + 1).tolist()
        if self.held is not None and ends:
            out.append((self.place, "whole" if self.mine else "head", b"".join([*self.held, text[:ends.pop(0)]])))
            self.held = None
        elif self.held is not None:
            self.held.append(text)
        out += [(self.done + lo, "whole", text[lo:hi]) for lo, hi in zip(starts, ends, strict=False)]
        if len(starts) > len(ends):
            self.held, self.place, self.mine = [text[starts[len(ends)]:]], self.done + starts[len(ends)], True
        self.done += len(text)
        return out

    def rest(self) -> list[tuple[int, str, bytes]]:
        """What is open at the end of the range: a 'tail' that began here, or the 'middle' of an element."""
        return [] if self.held is None else [(self.place, "tail" if self.mine else "middle", b"".join(self.held))]


def _parts(batches):
    """(batch, row, file, start, text) for the rows of one range in a batch, in order; the separator is put back."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        files, starts = batch.column("file").to_pylist(), batch.column("start").to_pylist()
        values = pc.fill_null(batch.column("value"), "").cast(pa.binary())
        cuts = [i for i in range(1, batch.num_rows) if starts[i] != starts[i - 1] or files[i] != files[i - 1]]
        for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if hi > lo:
                yield batch, lo, files[lo], starts[lo], b"}".join([*values.slice(lo, hi - lo).to_pylist(), b""])


SUMS = "file string, start long, first string, bytes long, turns int, outside long, within long"


def _summed(batches):
    """A row per range: its first byte that is no space, its length, the parity of its quotes, the change of depth if begun outside or inside a string."""
    import pyarrow as pa

    ranges: dict = {}
    for _, _, file, start, text in _parts(batches):
        r = ranges.setdefault((file, start), {"first": None, "bytes": 0, "inside": [False, True], "depth": [0, 0]})
        r["bytes"] += len(text)
        r["first"] = r["first"] or text.strip()[:1].decode("latin-1") or None
        for k in (0, 1):
            step, r["inside"][k] = structure(np.frombuffer(text, np.uint8), r["inside"][k])
            r["depth"][k] += int(step.sum(dtype=np.int64))
    rows = [(*k, r["first"], r["bytes"], int(r["inside"][0]), *r["depth"]) for k, r in ranges.items()]
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=[x.split()[0] for x in SUMS.split(", ")])


ELEMENTS = "file string, pos long, part string, text string"


def _cut(batches):
    import pyarrow as pa

    def given(rows):
        text = pa.array([r[2].decode("utf-8", "replace") for r in rows], pa.string())
        return pa.RecordBatch.from_arrays([pa.array([now[0]] * len(rows), pa.string()), pa.array([offset + r[0] for r in rows], pa.int64()),
                                           pa.array([r[1] for r in rows], pa.string()), text], names=[x.split()[0] for x in ELEMENTS.split(", ")])

    now, cutter, offset = None, None, 0
    for batch, at, file, start, text in _parts(batches):
        if (file, start) != now:
            if cutter:
                yield given(cutter.rest())
            now, cutter = (file, start), Range(batch.column("inside")[at].as_py(), batch.column("depth")[at].as_py())
            offset = batch.column("offset")[at].as_py()
        yield given(cutter.feed(text))
    if cutter:
        yield given(cutter.rest())


#: So many ranges have their states broadcast (some 100 bytes each); beyond that they are joined, and the pieces sorted again.
BROADCAST = 1 << 20


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, text) for the objects in the outer arrays of JSON files; ``pos`` is the byte in the file.

    Files that are not arrays give no rows; elements that are not objects are
    dropped.  Of a file that breaks off, the objects before the break are given.
    One object must fit a Spark string, nothing else has a bound.
    """
    pieces = spark.read.option("lineSep", "}").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"))
    sums = stored(pieces.select("value", "file", "start").mapInArrow(_summed, SUMS), "ranges")
    order = Window.partitionBy("file").orderBy("start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    told = sums.withColumn("offset", F.coalesce(F.sum("bytes").over(before), F.lit(0)))
    told = told.withColumn("inside", F.coalesce(F.sum("turns").over(before), F.lit(0)) % 2 == 1)
    told = told.withColumn("depth", F.coalesce(F.sum(F.when(F.col("inside"), F.col("within")).otherwise(F.col("outside"))).over(before), F.lit(0)))
    told = told.withColumn("first", F.first("first", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    told = told.filter("first = '['").select("file", "start", "offset", "inside", "depth")
    if sums.count() <= BROADCAST:
        ready = pieces.join(F.broadcast(told), ["file", "start"])
    else:
        ready = pieces.join(told, ["file", "start"]).sortWithinPartitions("file", "start", "id")
    cut = stored(ready.select("value", "file", "start", "offset", "inside", "depth").mapInArrow(_cut, ELEMENTS), "elements")

    # what goes over the end of a range: a tail, any middles, a head
    place = Window.partitionBy("file").orderBy("pos")
    parts = cut.filter("part <> 'whole'").withColumn("element", F.sum((F.col("part") == "tail").cast("int")).over(place))
    joined = parts.groupBy("file", "element").agg(F.sort_array(F.collect_list(F.struct("pos", "part", "text"))).alias("x"))
    joined = joined.filter((F.col("x")[0]["part"] == "tail") & (F.element_at("x", -1)["part"] == "head")).select(
        "file", F.col("x")[0]["pos"].alias("pos"), F.array_join(F.col("x.text"), "").alias("text"))
    return cut.filter("part = 'whole'").select("file", "pos", "text").unionByName(joined).filter(F.col("text").startswith("{"))
