"""Raw JSON sources and raw-first landing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewops.functions.text import col_
from reviewops.functions.values import safe_timestamp
from reviewops.sources.arrays import read_elements


def read_json_dataset(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A1: files holding a JSON array of objects -> one row per object.

    A file of any size is read by as many tasks as it has splits
    (``sources.arrays``).  A non-array document yields no rows and non-object
    elements are dropped; objects are parsed with an explicit schema (no
    inference pass over the data).  ``pos`` orders the objects of a file.
    """
    items = read_elements(spark, path)
    return items.select("pos", F.from_json("text", schema).alias("_o"), F.col("text").alias("raw_json")).select("pos", "_o.*", "raw_json")


def parse_json_array(df: DataFrame, col: str, schema: T.StructType) -> DataFrame:
    """A1 on a column holding JSON array text; keeps the other columns."""
    items = F.from_json(col_(col), T.ArrayType(T.StringType()))
    objs = df.select(*[c for c in df.columns if c != col],
                     F.posexplode_outer(items).alias("pos", "_item"))
    objs = objs.filter(F.col("_item").startswith("{"))
    return objs.select(*[c for c in objs.columns if c != "_item"],
                       F.from_json("_item", schema).alias("_o"), F.col("_item").alias("raw_json")) \
        .select(*[c for c in objs.columns if c != "_item"], "_o.*", "raw_json")


def parse_json_column(df: DataFrame, col: str, schema: T.StructType, keep_raw: bool = True,
                      once: bool = False) -> DataFrame:
    """A1 for one JSON object per row: fields of ``schema`` as columns.

    Rows that are not JSON objects get NULL fields (``_corrupt`` = true).

    By default Catalyst prunes the parse to the fields a query reads, but a
    filter on a parsed field is pushed below the projection as a second parse.
    ``once=True`` is for consumers that read every field and filter on some
    (ingest): the parse is then the output of a one-row generator, filters
    stay above it, and each row is parsed exactly once."""
    parsed = F.from_json(col_(col), schema)
    if once:
        out = df.select("*", F.inline(F.array(F.struct(parsed.alias("_o")))))
    else:
        out = df.withColumn("_o", parsed)
    cols = [c for c in df.columns if keep_raw or c != col]
    return out.select(*cols, "_o.*", F.col("_o").isNull().alias("_corrupt"))


def land_raw(df: DataFrame, key: str, ts: str, raw: str | None = None) -> DataFrame:
    """A2: raw-first landing row: key, the complete original JSON, scrape time.

    ``raw`` names a column already holding the original text; otherwise the
    whole row is serialised with ``to_json``.
    """
    body = col_(raw) if raw else F.to_json(F.struct(*[c for c in df.columns]))
    return df.select(F.col(key).cast("string").alias(key), body.alias("raw_json"),
                     F.col(ts).alias("scraped_at"))


def raw_fields(df: DataFrame, raw: str, fields: dict) -> DataFrame:
    """A3: read fields back out of landed JSON: ``{name: (path, type)}``.

    Uses VARIANT (``parse_json`` + ``try_variant_get``): one parse per row, and a
    wrong type yields NULL instead of failing the job.
    """
    v = F.try_parse_json(col_(raw))
    return df.select("*", *[F.try_variant_get(v, path, typ).alias(name)
                            for name, (path, typ) in fields.items()])


def conform(df: DataFrame, schema: T.StructType, not_null=None, max_len: dict | None = None):
    """A4: cast / order / add columns to a table schema and split off bad rows.

    Returns ``(good, bad)``; ``bad`` carries ``_errors`` (array of messages)
    for NULLs in NOT NULL columns and strings longer than their limit.
    """
    not_null = list(not_null if not_null is not None else [f.name for f in schema if not f.nullable])
    max_len = max_len or {}
    cols = []
    for f in schema:
        src = F.col(f.name) if f.name in df.columns else F.lit(None)
        cols.append(src.try_cast(f.dataType).alias(f.name))
    typed = df.select(*cols)
    errs = [F.when(F.col(c).isNull(), F.lit(f"null:{c}")) for c in not_null]
    errs += [F.when(F.length(F.col(c)) > n, F.lit(f"too_long:{c}")) for c, n in max_len.items()]
    tagged = typed.withColumn("_errors", F.filter(F.array(*errs), lambda x: x.isNotNull())) if errs \
        else typed.withColumn("_errors", F.array().cast("array<string>"))
    good = tagged.filter(F.size("_errors") == 0).drop("_errors")
    bad = tagged.filter(F.size("_errors") > 0)
    return good, bad


POST_RESPONSE = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("media_type", T.StringType()), T.StructField("media_url", T.StringType()),
    T.StructField("permalink", T.StringType()), T.StructField("timestamp", T.StringType()),
])


def post_log(df: DataFrame, response_col: str = "response") -> DataFrame:
    """Published-post API responses -> post log rows (id present only)."""
    p = F.from_json(col_(response_col), POST_RESPONSE)
    out = df.select(p.alias("_p")).select(
        F.col("_p.id").alias("id"), F.col("_p.text").alias("text"),
        F.col("_p.media_type").alias("media_type"), F.col("_p.media_url").alias("media_url"),
        safe_timestamp(F.regexp_replace("_p.timestamp", r"([+-]\d\d)(\d\d)$", "$1:$2")).alias("timestamp"),
        F.col("_p.permalink").alias("permalink"))
    return out.filter(F.col("id").isNotNull())


def flatten_nested(df: DataFrame, sep: str = ".", depth: int | None = None) -> DataFrame:
    """B1: struct fields -> flat columns named ``parent<sep>child`` (like
    ``pandas.json_normalize``); arrays and maps stay as they are."""
    def walk(schema: T.StructType, prefix: list[str], level: int):
        for f in schema.fields:
            path = prefix + [f.name]
            if isinstance(f.dataType, T.StructType) and (depth is None or level < depth):
                yield from walk(f.dataType, path, level + 1)
            else:
                ref = F.col(".".join(f"`{p}`" for p in path))
                yield ref.alias(sep.join(path))
    return df.select(*list(walk(df.schema, [], 0)))
