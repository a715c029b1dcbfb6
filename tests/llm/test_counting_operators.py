"""Source divergence, Pitman-Yor scoring and spelling variants against brute force, and on odd rows."""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from reviewops.llm import divergence, pitman_yor, spelling, words

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, term string, word string, n long, row long, bucket int, first long"
LONG = "thinking thinkings über x1y " * 40_000
EXTRA = ("t", "w", 1, 1, 1, 1)
ROWS = [(1, None, "en", "a", *EXTRA), (2, "", None, None, *EXTRA), (3, LONG, "en", "a", *EXTRA), (4, "Thinking, thinkings!   naïve", "en", "b", *EXTRA),
        (4, "Thinking, thinkings!   naïve", "en", "b", *EXTRA), (5, "thinkin thinking thonking", "en", "c", *EXTRA), (None, "thinking", "", "c", *EXTRA),
        (None, "über über", "de", None, *EXTRA), (6, "123 !!! ???", "en", "d", *EXTRA), (7, "x", "en", "c", *EXTRA)]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower(text):
    return (text or "").translate(str.maketrans(UPPER, LOWER))


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_words(monkeypatch):
    monkeypatch.setattr(words, "PIECE", 10)
    assert [w for part in words.words_of("Ab c  d\te ÉF gh ij\x0bk".encode()) for w in part] == [w.encode() for w in ("ab c", "d", "e", "Éf", "gh", "ij", "k")]


# 11
def divergence_of(rows):
    groups, seen, count = defaultdict(set), defaultdict(set), Counter()
    for i, r in enumerate(rows):
        lang, source = r[2] or "", r[3] or ""
        groups[lang].add(source)
        for term in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(r[1])):
            seen[lang, term].add(i)
            count[lang, source, term] += 1
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for g, t in seen if g == lang and len(seen[g, t]) >= 3)
        share = lambda n, total: 1 + 10 ** 9 * (n + 1) // (total + len(kept))  # noqa: B023, E731
        f = lambda p, q: (p - q) ** 2 // q
        table = {s: {t: count[lang, s, t] for t in kept} for s in sources}
        whole = {t: sum(table[s][t] for s in sources) for t in kept}
        p = {s: {t: share(table[s][t], sum(table[s].values())) for t in kept} for s in sources}
        q = {t: share(whole[t], sum(whole.values())) for t in kept}
        for s in sources:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources - {s})
            terms = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if table[s][t] and p[s][t] > q[t])
            for part, ranked in (("pair", pairs), ("term", terms[:200])):
                out += [(lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(ranked)]
    return sorted(out)


def test_divergence_odd_rows(odd):
    got = divergence.divergence(odd).select("lang", "source", "part", "item", "value", "rank").collect()
    assert sorted(map(tuple, got)) == divergence_of(ROWS)


def test_divergence_small_tasks(spark, odd, monkeypatch):
    """The same rows when tasks give their counts all the time, and terms go on over batches."""
    for name, value in (("WORDS", 5), ("DIFFERENT", 3), ("ROWS", 2), ("PAIRS", 1)):
        monkeypatch.setattr(divergence, name, value)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        rows = [r for r in ROWS if r[1] != LONG] * 2
        got = divergence.divergence(spark.createDataFrame(rows, DOCS)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10000)
    assert sorted(map(tuple, got)) == divergence_of(rows)


def test_divergence_empty(none):
    assert divergence.divergence(none).collect() == []


def test_share_is_exact(spark):
    rows = [(0, 1), (9 * 10 ** 9 - 1, 10 ** 17 + 7), (9 * 10 ** 9, 10 ** 17 + 7), (4 * 10 ** 17, 9 * 10 ** 17)]
    got = spark.createDataFrame(rows, "n long, total long").select("n", "total", divergence.share(F.col("n"), F.col("total")).alias("p")).collect()
    assert [r["p"] for r in got] == [1 + 10 ** 9 * (n + 1) // t for n, t in rows]


# 12
def tokens(text):
    return (text or "").encode().lower().split() + [b""]


def base_of(rows):
    train = Counter(t for r in rows if zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 7 != 2 for t in tokens(r[1]))
    n, v = sum(train.values()), len(train)
    out = []
    for r in rows:
        w = tokens(r[1])
        out.append((r[0], zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 7 == 2, len(w), sum(train[t] > 0 for t in w), n,
                    round(sum(math.log10((train[t] + 1) / (n + v + 1)) for t in w), 4)))
    return sorted(out, key=str)


def scored(docs):
    return pitman_yor.score(docs, pitman_yor.train(docs.filter(~pitman_yor.held_out())))


@pytest.mark.parametrize("bucket", [1 << 22, 1 << 10])
def test_lm_base_and_reruns(odd, monkeypatch, bucket):
    monkeypatch.setattr(pitman_yor, "BUCKET", max(bucket, sum(len(r[1] or "") for r in ROWS) // 70 if bucket < 1 << 20 else bucket))
    monkeypatch.setattr(pitman_yor, "TOKENS", bucket)
    got = scored(odd).collect()
    assert sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got), key=str) == base_of(ROWS)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    again = {(r["doc_id"], r["n_tokens"]): r["score"] for r in scored(odd.coalesce(1)).collect()}
    assert all(again[r["doc_id"], r["n_tokens"]] == pytest.approx(r["score"], rel=1e-5) for r in got)


def test_lm_probabilities_sum_to_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = pitman_yor.train(docs)
    numbers = model.numbers()
    buckets = [pitman_yor.Words(r.asDict(), numbers) for r in model.state.collect()]
    for ctx in (0, 5, pitman_yor.context(b"the"), pitman_yor.context(b"zzz")):
        total = sum(b.probability(np.arange(len(b.words)), np.full(len(b.words), ctx)).sum() for b in buckets)
        assert total + buckets[0].probability(np.array([-1]), np.array([ctx]))[0] == pytest.approx(1, abs=1e-9)


def test_lm_has_a_restaurant_for_each_word_before(spark):
    """running and sitting end alike, so they shared one."""
    assert len({pitman_yor.context(w) for w in (b"running", b"sitting", b"thing", b"ing")}) == 4
    rows = [(i, "running water" if i % 2 else "sitting down") for i in range(400)]
    model = pitman_yor.train(spark.createDataFrame(rows, "doc_id long, text string"))
    row, = model.state.collect()
    words = pitman_yor.Words(row.asDict(), model.numbers())
    at = np.array([words.words.index(b"water"), words.words.index(b"down")])
    for before, (water, down) in ((b"running", (True, False)), (b"sitting", (False, True))):
        p = words.probability(at, np.full(2, pitman_yor.context(before)))
        assert (p[0] > 0.9) == water and (p[1] > 0.9) == down


@pytest.mark.parametrize("share", [1, 1 << 12])
def test_lm_scores_are_those_of_one_bucket(spark, monkeypatch, share):
    """Buckets, spread words, the homes of contexts, and contexts that a bucket does not know change no score."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60).localCheckpoint()
    monkeypatch.setattr(pitman_yor, "SPREAD", share)
    monkeypatch.setattr(pitman_yor, "BUCKET", 1 << 12)
    many = {r["doc_id"]: r["score"] for r in scored(docs).collect()}
    monkeypatch.setattr(pitman_yor, "BUCKET", 1 << 30)
    monkeypatch.setattr(pitman_yor, "SPREAD", 1 << 12)
    one = {r["doc_id"]: r["score"] for r in scored(docs).collect()}
    assert len(one) == 60 and many == pytest.approx(one, rel=1e-5)


def test_lm_asks_a_home_once_for_all_parts(spark, monkeypatch):
    """However many parts the texts come in; a row for each part, too, grew with the parts times the homes times the buckets."""
    asked, kept = [], pitman_yor.written

    def written(df, name, *more):
        df = kept(df, name, *more)
        if "home" in df.columns and "logs" in df.columns:
            asked.append(df.filter("home IS NOT NULL").count())
        return df

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60).localCheckpoint()
    model = pitman_yor.train(docs.filter("doc_id % 2 = 0"))
    monkeypatch.setattr(pitman_yor, "written", written)
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        assert pitman_yor.score(docs, model).count() == 60
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert 0 < sum(asked) <= len(asked) * model.buckets * model.homes


def test_lm_beats_the_base_on_held_out_texts(spark):
    got = entry.queries()["op12_lm_scoring"](spark, "/root/testdata/sf0.01").filter("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert 10 ** (-got[0] / got[2]) < 0.7 * 10 ** (-got[1] / got[2])


def test_seating_one_by_one():
    """Expected tables after c customers, by summing over all ways to sit."""
    def expected(c, a, p, d):
        at = {1: 1.0}
        for i in range(1, c):
            nxt = defaultdict(float)
            for t, q in at.items():
                new = (a + d * p * t) / (a + d * p * t + i - d * t)
                nxt[t + 1] += q * new
                nxt[t] += q * (1 - new)
            at = nxt
        return sum(t * q for t, q in at.items())

    m = 40_000
    for c, a, p, d in ((1, 0.5, 0.1, 0.5), (2, 0.5, 0.1, 0.5), (9, 3.0, 0.2, 0.7), (14, 0.01, 0.5, 0.2)):
        t = pitman_yor.seated(np.full(m, c), np.full(m, a), p, d, pitman_yor.draws(np.arange(m, dtype=np.uint64), c, 1))
        assert t.min() >= 1 and t.max() <= c and t.mean() == pytest.approx(expected(c, a, p, d), rel=0.02)
    many = pitman_yor.seated(np.array([10 ** 9, 5, 10 ** 9]), np.array([1e3, 1.0, 1e3]), 0.1, 0.5, pitman_yor.draws(np.arange(3, dtype=np.uint64), 0, 0))
    assert many.max() < 10 ** 9 and many[1] <= 5


def test_lm_without_training_and_empty(odd, none):
    got = pitman_yor.score(odd, pitman_yor.train(none)).collect()
    assert len(got) == len(ROWS) and all(r["score"] == r["base_score"] == 0 and r["n_known"] == r["train_tokens"] == 0 for r in got)
    assert scored(none).collect() == []


# 13
def variants_of(rows):
    count = Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", lower(r[1])):
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += len(run) >= 7
    n = {w: c for w, c in count.items() if c >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    met = {w: [v for v in n if v != w and near(w, v)] for w in n}
    form = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in met.items() if vs}
    form = {w: f for w, f in form.items() if n[f] >= 10 * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(met[w]), n[form[w]] if w in form else None))
    return sorted(out)


def spelled(docs):
    return sorted(map(tuple, spelling.variants(docs).collect()))


def chains(spark):
    many = [("thinking", 2000), ("thinkking", 150), ("thinkkking", 12), ("thinkkkinq", 2), ("abcdefg", 30), ("abcdefh", 30), ("abcdef", 99), ("abcxefgi", 3), ("abcdefgi", 3), ("gfedcba", 5),
            ("éàüöñßæ", 20), ("éàüöñßæø", 2), ("a" * 700, 3), ("a" * 701, 40), ("a" * 699 + "b", 2)]
    rows = [(i, " ".join([w] * n)) for i, (w, n) in enumerate(many)] + [(99, None), (99, ""), (99, "abcdefi abcdefi"), (99, "abcdefi abcdefi")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def test_variants_chains_and_ties(spark):
    rows, docs = chains(spark)
    assert spelled(docs) == variants_of(rows)


def test_variants_cut_blocks(spark, monkeypatch):
    """The same when each piece of a block has two words and few visitors."""
    monkeypatch.setattr(spelling, "BLOCK", 2)
    monkeypatch.setattr(spelling, "VISITORS", 1)
    monkeypatch.setattr(spelling, "ENTRIES", 3)
    monkeypatch.setattr(spelling, "VERIFIED", 20)
    rows, docs = chains(spark)
    letters = ["".join(x) for x in itertools.product("abc", "def", "gha", "bde")]
    more = [(200 + i, " ".join(["xyzz" + w] * (1 + i % 4 * 20))) for i, w in enumerate(letters)]
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    assert spelled(docs) == variants_of(rows + more)


def test_variants_odd_rows(odd, none):
    assert spelled(odd) == variants_of(ROWS)
    assert spelled(none) == []
