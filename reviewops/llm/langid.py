"""Language identification by error-correcting output codes.

Every language gets a codeword of bits.  One binary n-gram classifier per bit
(log odds of hashed letter trigrams, from counts over all training texts)
tells on which side a text lies.  A text's language is the codeword with the
smallest weighted logistic loss; bits that separate the training languages
better weigh more.  A text is ambiguous if the two nearest codewords lose
about the same.

Counts are made over whole texts of all training rows, per task and then
summed.  They stay a Spark table (language, feature), whatever the number of
languages: the driver gets 2**15 sums per bit and side, and a name, a total
and a codeword per language.

Null texts and texts without letters are ``und`` with score 0.  Rows with null
language are not trained on.  Without training rows every text is ``und``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewops.llm.common import text_of, utf8_column, written
from reviewops.llm.shingles import pieces

FEATURES, SMOOTHING = 1 << 15, 0.5
#: Languages that a task counts at once; it gives its counts and goes on where more come up.
SLOTS = 64
#: Rows times languages whose losses are held at once.
CELLS = 1 << 21
UNKNOWN = "und"
#: Texts whose two nearest codewords are closer than this (share of confidence) are ambiguous.
MARGIN = 0.05
#: ASCII letters in lower case, other ASCII as space, the bytes of other letters as they are.
_BYTE = np.full(256, 32, np.uint8)
_BYTE[128:] = np.arange(128, 256)
_BYTE[97:123] = np.arange(97, 123)
_BYTE[65:91] = np.arange(97, 123)


def trigrams(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, row) of each byte trigram inside a row; those with two spaces in a row are left out."""
    b = _BYTE[data].astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    f = ((b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(2654435761)) >> np.uint32(32 - 15)
    space = b == 32
    good = ~(space[1:-1] & (space[:-2] | space[2:]))
    for end in bounds[1:-1]:
        good[max(0, end - 2):end] = False
    at = np.flatnonzero(good)
    return f[at].astype(np.int64), np.searchsorted(bounds, at, "right") - 1


def lowered(column):
    import pyarrow.compute as pc

    return pc.utf8_lower(pc.fill_null(column, ""))


def _counts(batches):
    """(lang, feature, n); feature 0 is given for each language, so none is lost for want of trigrams."""
    import pyarrow as pa

    slot, total = {}, np.zeros(SLOTS * FEATURES, np.int64)

    def given():
        names, named = pa.array(list(slot), pa.string()), total > 0
        named[np.arange(len(slot)) * FEATURES] = True
        at = np.flatnonzero(named)
        return pa.RecordBatch.from_arrays([names.take(pa.array(at // FEATURES)), pa.array(at % FEATURES), pa.array(total[at])], names=["lang", "feature", "n"])

    for batch in batches:
        lang = batch.column("lang").to_pylist()
        data, offsets = utf8_column(lowered(batch.column("text")))
        for lo, hi in pieces(offsets):
            while lo < hi:
                at, ids = lo, []
                while at < hi and (lang[at] in slot or len(slot) < SLOTS):
                    ids.append(slot.setdefault(lang[at], len(slot)))
                    at += 1
                if ids:
                    f, row = trigrams(data[offsets[lo]:offsets[at]], offsets[lo:at + 1] - offsets[lo])
                    total[:len(slot) * FEATURES] += np.bincount(np.array(ids, np.int64)[row] * FEATURES + f, minlength=len(slot) * FEATURES)
                if at < hi:
                    yield given()
                    slot.clear()
                    total[:] = 0
                lo = at
    yield given()


def codewords(n: int) -> np.ndarray:
    """n codewords of +1 and -1: the exhaustive code up to six languages, else the farthest of some random codes (of fewer, the more languages)."""
    if n <= 1:
        return np.ones((n, 0))
    if n <= 6:
        cols = [[1, *(1 if (c >> i) & 1 else -1 for i in range(n - 1))] for c in range(2 ** (n - 1) - 1)]
        return np.array(cols, float).T
    bits, best, far = 8 * int(np.ceil(np.log2(n))), None, -1
    tries, seed = min(200, max(1, 200 * 64 * 64 // (n * n))), 0
    while seed < tries or best is None:
        code = np.where(np.random.default_rng(seed).random((n, bits)) < 0.5, -1.0, 1.0)
        seed += 1
        if (np.abs(code.sum(0)) == n).any():
            continue
        if tries > 1:
            least = (bits - np.max(code @ code.T - 2 * bits * np.eye(n))) / 2
        else:
            least = len(np.unique(np.packbits(code > 0, axis=1), axis=0)) - n + 1      # 1 if all differ
        if least > max(far, 0):
            best, far = code, least
    return best


class Model:
    """Languages with their codewords, a weight per feature and bit, a weight per bit."""

    def __init__(self, langs: list[str], code: np.ndarray, weight: np.ndarray, bit: np.ndarray):
        self.langs, self.code, self.weight, self.bit = langs, code.astype(np.int8), weight, bit

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Per row and bit: evidence per trigram times the root of their number."""
        out = np.zeros((len(offsets) - 1, self.weight.shape[1]))
        for lo, hi in pieces(offsets):
            f, row = trigrams(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
            n = np.bincount(row, minlength=hi - lo)
            for j in range(out.shape[1]):
                out[lo:hi, j] = np.bincount(row, weights=self.weight[:, j][f], minlength=hi - lo)
            out[lo:hi] /= np.sqrt(np.maximum(n, 1))[:, None]
        return out

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the nearest codeword, confidence, ambiguous); some rows at a time."""
        code, out = self.code.astype(float).T, []
        for block in np.array_split(margins, 1 + len(margins) * len(self.langs) // CELLS):
            # the logistic losses of both sides of a bit differ by the margin, so losses differ by sums of margins
            gain = (block * self.bit) @ code
            like = np.exp(4 * (gain - gain.max(1, keepdims=True)))
            like /= like.sum(1, keepdims=True)
            top = np.partition(like, -2, 1)[:, -2:] if like.shape[1] > 1 else np.concatenate((np.zeros_like(like), like), 1)
            out.append((like.argmax(1), top[:, 1], top[:, 1] - top[:, 0] < MARGIN))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model | None:
    """Counts over all rows with a language; None without any."""
    rows = docs.select(text_of(text).alias("text"), F.col(lang).alias("lang")).filter("lang is not null")
    counts = written(rows.mapInArrow(_counts, "lang string, feature long, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")), "trigrams")
    found = sorted((r["lang"], r["n"]) for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect())
    if not found:
        return None
    langs, code = [x for x, _ in found], codewords(len(found))
    bits = code.shape[1]
    if not bits:
        return Model(langs, code, np.zeros((FEATURES, 0), np.float32), np.ones(0))
    # a language's share of a feature is scale * (n + SMOOTHING)
    scale = 1 / (np.array([n for _, n in found], float) + SMOOTHING * FEATURES)
    shares = counts.join(_sides(docs, langs, scale, code), "lang").withColumn("share", F.col("n") * F.col("scale"))
    weight = _weights(shares, scale, code)
    return Model(langs, code, weight, _bit_weights(shares, weight))


def _sides(docs: DataFrame, langs: list[str], scale: np.ndarray, code: np.ndarray) -> DataFrame:
    """(lang, scale, code): one row per language."""
    import pyarrow as pa

    side = pa.FixedSizeListArray.from_arrays(pa.array(code.ravel()), code.shape[1]).cast(pa.list_(pa.float64()))
    made = docs.sparkSession.createDataFrame(pa.table({"lang": pa.array(langs, pa.string()), "scale": pa.array(scale), "code": side}))
    return written(made, "sides")


def _weights(shares: DataFrame, scale: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Log odds of each feature on the two sides of each bit, summed up over the languages by Spark."""
    bits = range(code.shape[1])
    sums = [F.sum(F.when(F.col("code")[j] * s > 0, F.col("share")).otherwise(0.0)).alias(f"{c}{j}") for c, s in (("p", 1), ("q", -1)) for j in bits]
    got = shares.groupBy("feature").agg(*sums).toPandas()
    weight, at = np.zeros((FEATURES, len(bits)), np.float32), got["feature"].to_numpy(np.int64)
    for j in bits:
        mean = []
        for c, on in (("p", code[:, j] > 0), ("q", code[:, j] < 0)):
            total = np.zeros(FEATURES)
            total[at] = got[f"{c}{j}"].to_numpy(float)
            mean.append((total + SMOOTHING * scale[on].sum()) / on.sum())
        weight[:, j] = np.log(mean[0] / mean[1])
    return weight


def _bit_weights(shares: DataFrame, weight: np.ndarray) -> np.ndarray:
    """Per bit how far a typical text of the language nearest to the other side lies on its own side."""
    import pyarrow as pa

    bits, rest = range(weight.shape[1]), SMOOTHING * weight.sum(0, dtype=float)
    lists = pa.FixedSizeListArray.from_arrays(pa.array(weight.ravel()), len(bits)).cast(pa.list_(pa.float32()))
    made = shares.sparkSession.createDataFrame(pa.table({"feature": pa.array(np.arange(FEATURES)), "w": lists}))
    on = shares.join(written(made, "weights"), "feature").groupBy("lang").agg(
        F.first("scale").alias("scale"), F.first("code").alias("code"), *[F.sum(F.col("share") * F.col("w")[j]).alias(f"s{j}") for j in bits])
    least = on.agg(*[F.min((F.col(f"s{j}") + F.col("scale") * F.lit(float(rest[j]))) * F.col("code")[j]).alias(f"m{j}") for j in bits]).first()
    bit = np.maximum(1e-3, np.array(least, float))
    return bit / bit.sum()


def _predict(shared, text: str, keep_only: bool):
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        model = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(text).cast(pa.string())
            known = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            lang, score, close = np.full(len(known), UNKNOWN, object), np.zeros(len(known)), np.ones(len(known), bool)
            if model is not None:
                best, sure, near = model.decode(model.margins(*utf8_column(lowered(column))))
                lang[known] = np.array(model.langs, object)[best[known]]
                score[known], close[known] = sure[known], near[known]
            if keep_only:
                yield batch.filter(pa.array(~close))
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(close)],
                                                 names=["doc_id", "lang_pred", "score", "ambiguous"])
    return run


def predict(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, ambiguous for every row; only the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_predict(shared, "text", False), f"doc_id {dict(rows.dtypes)['doc_id']}, lang_pred string, score double, ambiguous boolean")


def identified(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` without the rows that are ``und`` or ambiguous."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_predict(shared, text, True), docs.schema)


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the id as text leaves 1 modulo 3; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1
