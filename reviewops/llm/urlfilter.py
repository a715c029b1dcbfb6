"""URL filter: host and path rules, else word segmentation and naive Bayes.

Names run together in host names are split into words by a unigram Viterbi.
The word counts come from the whole table: every word of the paths and of
hyphenated host labels, and every word of the page titles.  Other host labels
are names that may be run together; they count as words, once a host, only
where ``SHARED`` hosts have them (com, www, blog).  Substrings of the distinct
names are joined with the counts, so the counts are never sent around.

Multinomial naive Bayes scores the words of host and path.  Its classes come
from seed words (``BLOCK_WORDS``, fixed values): a url is a blocked example if
a word of its segmented host is a seed word.  Word counts by class cover all
urls; words are hashed into 2**16 places, so the model's size is bounded.  Each
class is smoothed towards the words of all urls, by as many counts as there
are different places: a word that neither class prefers decides nothing, however
unequal the classes are.

Null urls and urls without ``://`` have empty host and path, no words, and are
allowed.  Repeated rows each give a row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewops.llm.common import written

#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Words that mark a name as spam, adult, gambling, malware or advertising (fixed values).
BLOCK_WORDS = ("spam", "pills", "viagra", "casino", "bets", "betting", "poker", "gambling", "adult", "porn", "xxx", "sex", "escort",
               "ads", "adserver", "track", "tracker", "malware", "phishing", "warez", "crack", "torrent", "loans", "replica")
PLACES, LONGEST, SHARED, PIECE = 1 << 16, 20, 10, 256
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): the host lower-cased A-Z, the path up to ? or #; empty without ``://``."""
    told = F.coalesce(url, F.lit(""))
    rest = F.when(F.contains(told, F.lit("://")), F.substring(told, F.instr(told, "://") + 3, F.length(told))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    after = F.substring(rest, F.length(host) + 1, F.length(rest))
    return F.translate(host, UPPER, LOWER), F.regexp_extract(after, r"^[^?#]*", 0)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits, else null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def tokens(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def lexicon(pages: DataFrame, host: str = "host", path: str = "path", title: str = "title") -> DataFrame:
    """(word, n): how often each word occurs between separators; up to LONGEST characters, for longer ones are not looked up."""
    labels = F.filter(F.split(F.col(host), r"\."), lambda x: F.contains(x, F.lit("-")))
    words = F.concat(tokens(F.array_join(labels, " ")), tokens(F.col(path)), tokens(F.coalesce(F.col(title), F.lit(""))))
    counted = pages.select(F.explode(words).alias("word")).filter(F.length("word") <= LONGEST).groupBy("word").agg(F.count("*").alias("n"))
    names = (pages.select(F.col(host).alias("_h")).distinct().select(F.explode(F.array_distinct(tokens(F.col("_h")))).alias("word"))
             .filter(F.length("word") <= LONGEST).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= SHARED))
    seeds = pages.sparkSession.createDataFrame([(w, 1) for w in BLOCK_WORDS], "word string, n long")
    return counted.unionByName(names).unionByName(seeds).groupBy("word").agg(F.sum("n").alias("n"))


def viterbi(name: str, words: list[tuple[int, int, int]], total: int) -> list[str]:
    """The most probable split; words are (start, length, count).  An unknown stretch of n characters costs 10**-n / total a piece."""
    best, back = [0.0] + [-np.inf] * len(name), [0] * (len(name) + 1)
    by_start: dict[int, list[tuple[int, float]]] = {}
    for s, n, c in words:
        by_start.setdefault(s, []).append((n, np.log(c / total)))
    for s in range(len(name)):
        if s and best[s] == -np.inf:
            continue
        # a stretch that no word covers: one piece of any length, a tenth as probable for each character
        steps = by_start.get(s, [])
        for n in range(1, min(LONGEST, len(name) - s) + 1):
            steps = [*steps, (n, -np.log(total) - n * np.log(10.0))]
        for n, p in steps:
            if best[s] + p > best[s + n]:
                best[s + n], back[s + n] = best[s] + p, s
    out, end = [], len(name)
    while end:
        out.append(name[back[end]:end])
        end = back[end]
    return out[::-1]


def segmented(names: DataFrame, counts: DataFrame) -> DataFrame:
    """(name, words) for distinct names."""
    total, = counts.agg(F.sum("n")).first()
    # long names are cut into pieces first: a substring is found by counting characters from the start
    pieces = names.filter("name != ''").select("name", F.explode(F.sequence(F.lit(0), F.length("name") - 1, F.lit(PIECE))).alias("from"))
    pieces = pieces.select("name", "from", F.substring("name", F.col("from") + 1, F.lit(PIECE + LONGEST - 1)).alias("piece"))
    subs = pieces.select("name", "from", "piece", F.explode(F.sequence(F.lit(1), F.least(F.lit(PIECE), F.length("piece")))).alias("s"))
    subs = subs.select("name", "from", "piece", "s", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length("piece") - F.col("s") + 1))).alias("len"))
    subs = subs.select("name", (F.col("from") + F.col("s")).alias("s"), "len", F.substring("piece", F.col("s"), F.col("len")).alias("word"))
    held = subs.join(counts, "word").groupBy("name").agg(F.collect_list(F.struct((F.col("s") - 1).alias("s"), "len", "n")).alias("held"))

    def split(batches):
        import pyarrow as pa

        for b in batches:
            out = [viterbi(n, [(w["s"], w["len"], w["n"]) for w in h or ()], total or 1)
                   for n, h in zip(b.column("name").to_pylist(), b.column("held").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("name"), pa.array(out, pa.list_(pa.string()))], names=["name", "words"])

    return names.join(held, "name", "left").mapInArrow(split, "name string, words array<string>")


def place(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(PLACES)).cast("int")


def log_odds(n: np.ndarray) -> np.ndarray:
    """Log odds of block per place, from the counts of both classes (row 1: block); 0 where a place never occurs."""
    seen = n.sum(axis=0) > 0
    out = np.zeros(n.shape[1])
    if not seen.any():
        return out
    mean, weight = n.sum(axis=0)[seen] / n.sum(), seen.sum()
    share = (n[:, seen] + weight * mean) / (n.sum(axis=1, keepdims=True) + weight)
    out[seen] = np.log(share[1]) - np.log(share[0])
    return out


def judged(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", rules=RULES, seeds=BLOCK_WORDS) -> DataFrame:
    """page_id, host, path, rule, verdict, words, score (log odds of block)."""
    host, path = url_parts(F.col(url))
    title = F.regexp_extract(F.coalesce(F.col(html), F.lit("")), r"(?is)<title[^>]*>([^<]*)", 1)
    rows = written(pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"), title.alias("title")), "urls")

    hosts = rows.select("host").distinct()
    counts = written(lexicon(rows), "lexicon")
    named = hosts.select("host", F.posexplode(tokens(F.col("host"))).alias("at", "name"))
    split = segmented(named.select("name").distinct(), counts)
    by_host = (named.join(split, "name").groupBy("host")
               .agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "words"))), lambda x: x["words"])).alias("words")))
    by_host = written(by_host, "hosts")
    full = rows.drop("title").join(by_host, "host", "left")
    words = F.concat(F.coalesce("words", F.array().cast("array<string>")), tokens(F.col("path")))
    seed = F.arrays_overlap(F.concat(F.col("words"), tokens(F.col("host"))), F.array(*[F.lit(w) for w in seeds]))
    full = written(full.select("page_id", "host", "path", words.alias("words"), F.coalesce(seed, F.lit(False)).alias("seed")), "words")

    by_class = full.groupBy("seed").count().collect()
    got = (full.select("seed", F.explode(F.transform("words", place)).alias("place")).groupBy("seed", "place").agg(F.count("*").alias("n")).collect())
    n = np.zeros((2, PLACES))
    for r in got:
        n[int(r["seed"]), r["place"]] += r["n"]
    odds = log_odds(n)
    docs = {r["seed"]: r["count"] for r in by_class}
    prior = np.log((docs.get(True, 0) + 1) / (docs.get(False, 0) + 1))
    shared = pages.sparkSession.sparkContext.broadcast((odds, prior))

    def score(batches):
        import pyarrow as pa

        odds, prior = shared.value
        for b in batches:
            out = [float(prior + odds[p].sum()) if p else float(prior) for p in b.column("places").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("page_id", "host", "path", "words")] + [pa.array(out, pa.float64())],
                                             names=["page_id", "host", "path", "words", "score"])

    kind = dict(rows.dtypes)["page_id"]
    scored = (full.select("page_id", "host", "path", "words", F.transform("words", place).alias("places"))
              .mapInArrow(score, f"page_id {kind}, host string, path string, words array<string>, score double"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when((F.size("words") > 0) & (F.col("score") > 0), "block").otherwise("allow")
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "words", "score")
