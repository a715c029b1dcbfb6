"""Secret scan by a trigram inverted index (DataFrame functions only).

Each rule is a regular expression with a Boolean trigram query derived from
its literals: every match must hold all trigrams of one of the query's
branches.  ``postings`` lists, for each trigram that some query names, the
keys of the documents that hold it.  ``candidates`` intersects the postings
of a branch and unites the branches.  ``scan`` runs each rule's regular
expression on its candidates only; a rule without mandatory trigrams (a run
of hex digits) is run on every document.

Texts are read whole.  Null texts are empty; repeated rows each get the
result; empty tables give empty results; only doc_id and text are read, and
``scan`` keeps all other columns.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewops.llm.common import row_key, text_of


@dataclass(frozen=True)
class Rule:
    """``regex`` finds matches; those whose ``group`` has under ``least`` characters are dropped."""
    kind: str
    regex: str
    group: int = 0
    least: int = 1


#: In the order in which kinds are listed; the first three are the base kinds.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]+", 0, 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 20),
)
BASE = ("assign", "access", "hex")


def literal_runs(regex: str) -> list[list[str]]:
    """For each branch of a rule, the literal runs that every match holds.

    Understands what the rules are made of: literals, one-level groups of
    alternatives, classes, counted parts.  A literal that may be missing
    (``_?``) gives a branch with and one without it.  Small classes of
    literals (``[sr]``) are read as alternatives.
    """
    token = re.compile(r"\(\(\?i:(?P<alt>[\w|?]+)\)\)|\[(?P<small>[a-z]{1,5})\](?![+*?{])|(?P<class>\[[^\]]*\]|\([^)]*\)|\\x20)"
                       r"(?P<count>[+*?]|\{[\d,]*\})?|(?P<dot>\\\.)|(?P<lit>[\w -])(?P<opt>\?)?|(?P<other>.)")
    branches = [""]
    for m in token.finditer(regex):
        if m["alt"]:
            more = []
            for a in m["alt"].split("|"):
                cut = re.fullmatch(r"(\w*)(\w)\?(\w*)", a)
                more += [cut[1] + cut[2] + cut[3], cut[1] + cut[3]] if cut else [a]
        elif m["small"]:
            more = list(m["small"])
        elif m["lit"]:
            more = [m["lit"], ""] if m["opt"] else [m["lit"]]
        else:
            more = ["." if m["dot"] else "\0"]
        branches = [b + x for b, x in product(branches, more)]
    return [[run for run in b.split("\0") if run] for b in branches]


def trigram_query(regex: str) -> list[list[str]]:
    """Branches (or) of lower-case trigrams (and); empty if some branch has no trigram."""
    branches = [sorted({run[i:i + 3].lower() for run in runs for i in range(len(run) - 2)}) for runs in literal_runs(regex)]
    return [] if any(not b for b in branches) else branches


def postings(docs: DataFrame, key: str, text: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The inverted index (trigram, key) over all documents, for trigrams that some rule asks for."""
    grams = sorted({g for r in rules for b in trigram_query(r.regex) for g in b})
    # a one-row generator keeps the planner from lower-casing the text once for each trigram
    low = docs.select(F.col(key), F.explode(F.array(F.lower(F.col(text)))).alias("_low"))
    held = F.array_compact(F.array(*[F.when(F.contains(F.col("_low"), F.lit(g)), F.lit(g)) for g in grams]))
    return low.select(F.col(key), F.explode(held).alias("trigram"))


def candidates(index: DataFrame, key: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, kinds): the rules of which some branch has all its trigrams posted for the document."""
    asked = [(r.kind, f"{r.kind}{i}", g, len(b)) for r in rules for i, b in enumerate(trigram_query(r.regex)) for g in b]
    query = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(b).alias("branch"), F.lit(g).alias("gram"), F.lit(n).alias("need"))
                      for k, b, g, n in asked])
    rows = index.select(F.col(key), F.col("trigram"), F.explode(F.filter(query, lambda q: q["gram"] == F.col("trigram"))).alias("q"))
    met = (rows.groupBy(key, "q.kind", "q.branch", "q.need").agg(F.count_distinct("trigram").alias("have"))
           .filter(F.col("have") == F.col("need")))
    return met.groupBy(key).agg(F.collect_set("kind").alias("kinds"))


def spans_of(text: Column, rule: Rule) -> Column:
    """Array of (start, end, kind) of the rule's leftmost non-overlapping matches that pass."""
    whole = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0))
    part = whole if rule.group == 0 else F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group))
    gaps = F.split(text, rule.regex)
    # the start of match i: the lengths of the gaps up to it and of the matches before it
    steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(whole)), whole, lambda g, w: F.struct(F.length(g).alias("gap"), F.length(w).alias("len")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
    placed = F.aggregate(steps, start, lambda acc, s: F.struct(
        (acc["at"] + s["gap"] + s["len"]).alias("at"),
        F.concat(acc["out"], F.array(F.struct((acc["at"] + s["gap"]).alias("start"), (acc["at"] + s["gap"] + s["len"]).alias("end")))).alias("out")))["out"]
    kept = F.filter(F.arrays_zip(placed.alias("at"), F.transform(part, F.length).alias("n")), lambda x: x["n"] >= rule.least)
    return F.transform(kept, lambda x: F.struct(x["at"]["start"].alias("start"), x["at"]["end"].alias("end"), F.lit(rule.kind).alias("kind")))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with ``secret_spans``: array of (start, end, kind, rank), by start and then rank, in code points.

    Documents and candidates meet in one join on a 128-bit key of the row;
    copies have the same key only if their id is the same too, so a group of
    copies is no hot key.  A false candidate costs a look, never a result.
    """
    read = docs.withColumn("_k", row_key(F.col(doc_id), F.col(text)))
    index = postings(docs.select(row_key(F.col(doc_id), F.col(text)).alias("_k"), text_of(text).alias("_t")), "_k", "_t", rules)
    found = read.join(candidates(index, "_k", rules), "_k", "left")
    body = text_of(text)
    none = F.array().cast("array<struct<start:int,end:int,kind:string,rank:int>>")
    per_rule = []
    for rank, r in enumerate(rules):
        open_it = F.array_contains(F.coalesce("kinds", F.array().cast("array<string>")), r.kind) if trigram_query(r.regex) else F.lit(True)
        ranked = F.transform(spans_of(body, r), lambda s, rank=rank: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), F.lit(rank).alias("rank")))
        per_rule.append(F.when(open_it & body.rlike(r.regex), ranked).otherwise(none))
    in_order = lambda a, b: (F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["rank"] - b["rank"]))
    spans = F.array_sort(F.concat(*per_rule), in_order)
    return found.withColumn("secret_spans", spans).drop("_k", "kinds")


def told(spans: Column) -> Column:
    """``kind:start:end`` comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(scanned: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    s = F.col("secret_spans")
    count = lambda kind: F.size(F.filter(s, lambda x: x["kind"] == kind)).cast("long")
    base = F.filter(s, lambda x: x["kind"].isin(*BASE))
    return scanned.select(F.col(doc_id).alias("doc_id"), *[count(k).alias(f"n_{k}") for k in BASE],
                          F.sha2(told(base), 256).alias("base_sha256"), told(s).alias("spans"))


def masked(scanned: DataFrame, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """The text with every span replaced by ``mask``; overlapping spans by one mask."""
    body = text_of(text)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    step = lambda acc, s: F.when(s["end"] <= acc["at"], acc).otherwise(F.struct(
        s["end"].alias("at"),
        F.concat(acc["out"], F.when(s["start"] >= acc["at"], F.array(F.substring(body, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask)))
                 .otherwise(F.array().cast("array<string>"))).alias("out")))
    done = F.aggregate(F.col("secret_spans"), start, step)
    clean = F.concat(F.array_join(done["out"], ""), F.substring(body, done["at"] + 1, F.length(body)))
    return scanned.withColumn(text, F.when(F.size("secret_spans") > 0, clean).otherwise(F.col(text)))
