"""Byte dedup: every 400-byte string that starts more than once goes, by content-anchored hashing.

This stands in place of prefix-free parsing, whose dictionary does not pay on this kind of text: cut where a rolling
hash of 16 bytes triggers (one place in 128), 0.94 to 1.0 of all bytes are in distinct phrases, so a suffix array of
the dictionary has a row for nearly every byte of the corpus (162 million for 0.10 GB of Parquet).  Of the parsing,
the rolling-hash triggers are left: a window is filed under its first trigger (or, without one, its least hash), ``k``
names what follows that place and ``f`` the whole stretch of windows that share it.  Contexts that occur once drop out
at the first count; what is left is refined by cells of 48, 8 and 1 windows (``repeats``).

Two lengths are searched.  Strings of ``REPORT`` bytes that repeat are reported only: passages of some fifty words
often have fewer than 400 bytes.  Strings of 400 bytes that repeat lie in the stretches that those cover, so the second
search reads these stretches alone.

Matches never cross documents; strings are judged on the input.  Defined results for odd input: a null or empty
text has no bytes; repeated rows repeat each other; a null doc_id is a value like any other; columns besides
doc_id and text are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import repeats
from .common import dropped, keyed, slices, stored, texts

WIDTH = 400
REPORT = 256  # passages of some fifty words have fewer than 400 bytes; they are reported, not removed
_VALUES = repeats.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def byte_units(text: bytes) -> np.ndarray:
    return _VALUES[np.frombuffer(text, np.uint8)]


def kind(width: int = WIDTH) -> repeats.Kind:
    context = max(1, width * 4 // 25)
    return repeats.Kind(width, context, tuple(g for g in (48, 8, 1) if g == 1 or g * 4 <= width), byte_units, trigger=128, trigger_units=min(16, context))


def _digest(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "rk", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.encode("text", "utf-8"), 256).alias("sha"))


def _stretches(lists: DataFrame, width: int) -> DataFrame:
    """Maximal runs that repeated windows cover, as texts of their own: doc_id, rk, begin, text."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                units = part.column(part.schema.get_field_index("units"))
                rows, begin, text = [], [], []
                for i, t in enumerate(texts(part)):
                    for s, e in _runs(units[i].values, width):
                        rows.append(i), begin.append(s), text.append(t[s:e])
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_pydict({c: part.column(part.schema.get_field_index(c)).take(at) for c in ("doc_id", "rk")} | {"begin": pa.array(begin, pa.int64()), "text": pa.array(text, pa.binary())})

    return lists.mapInArrow(run, f"doc_id {lists.schema['doc_id'].dataType.simpleString()}, rk long, begin long, text binary")


def _runs(units: pa.StructArray, width: int) -> list[tuple[int, int]]:
    s, n = (np.asarray(c, np.int64) for c in units.flatten()[:2])
    return repeats.runs(s, s + n + width - 1)


def _removed(lists: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                spans = part.column(part.schema.get_field_index("spans"))
                rows = []
                for i, t in enumerate(texts(part)):
                    s, e = (np.asarray(c, np.int64) for c in spans[i].values.flatten())
                    at, h, gone = 0, hashlib.sha256(), repeats.runs(s, e)
                    for x, y in gone:
                        h.update(t[at:x])
                        at = y
                    h.update(t[at:])
                    rows.append((sum(y - x for x, y in gone), [{"s": x, "e": y} for x, y in gone], h.hexdigest()))
                cols = {n: part.column(part.schema.get_field_index(n)) for n in ("doc_id", "rk")}
                yield pa.RecordBatch.from_pydict(cols | {
                    "n_removed": pa.array([r[0] for r in rows], pa.int64()),
                    "removed": pa.array([r[1] for r in rows], pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))),
                    "kept_sha256": [r[2] for r in rows],
                })

    return lists.mapInArrow(run, f"doc_id {lists.schema['doc_id'].dataType.simpleString()}, rk long, n_removed long, removed array<struct<s:long,e:long>>, kept_sha256 string")


def removed(docs: DataFrame, width: int = WIDTH, report: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(keyed documents; by key that repeats something: n_repeated, and n_removed, removed, kept_sha256 or nulls).

    ``n_repeated``: bytes that repeated strings of ``report`` bytes (at most ``width``) cover.  Strings of ``width``
    bytes that repeat lie in such stretches, so only stretches are searched for them.
    """
    report = min(report or width, width)
    docs = keyed(docs)
    held, units = repeats.find(docs, kind(report))
    stretches = stored(_stretches(repeats.with_texts(held, units, "units"), report), "stretches")
    keys = ("doc_id", "rk", "begin")
    size = F.octet_length("text").cast("long")
    total = stored(stretches.groupBy("doc_id", "rk").agg(F.sum(size).alias("n_repeated")), "repeated")
    if report < width:
        dropped(units)
        inner, units = repeats.find(stretches.where(size >= width), kind(width), keys)
        dropped(inner)
    dropped(stretches)
    units = units if report < width else units.withColumn("begin", F.lit(0).cast("long"))
    each = units.select("doc_id", "rk", "begin", F.explode("units").alias("x"))
    span = F.struct((F.col("begin") + F.col("x.s")).alias("s"), (F.col("begin") + F.col("x.s") + F.col("x.n") + width - 1).alias("e"))
    spans = each.groupBy("doc_id", "rk").agg(F.collect_set(span).alias("spans"))
    cut = stored(_removed(repeats.with_texts(held, spans, "spans")), "removed")
    dropped(held, units)
    return docs, total.join(cut, repeats.same_row(total, cut), "left").select(total["doc_id"], total["rk"], "n_repeated", "n_removed", "removed", "kept_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, cut = removed(spark.read.parquet(f"{sf_dir}/documents.parquet"), WIDTH, REPORT)
    every = _digest(docs)
    cut = cut.select("doc_id", "rk", "n_repeated", "n_removed", F.size("removed").cast("long").alias("n_spans"), "kept_sha256")
    zero = F.lit(0).cast("long")
    return every.join(cut, repeats.same_row(every, cut), "left").select(
        every["doc_id"], "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"), F.coalesce("n_repeated", zero).alias("n_repeated"),
    )


def _runs_sql(width: int, name: str) -> str:
    """CTEs that end with {name}_run: r, s, e (from 1, e behind the end) of maximal runs under repeated strings."""
    return f"""{name}_w AS (
  SELECT r, i, md5(b[i : i + {width - 1}]) AS h FROM (SELECT r, b, unnest(range(1, octet_length(b) - {width - 2})) AS i FROM d WHERE octet_length(b) >= {width})
), {name}_hit AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS c FROM {name}_w) WHERE c > 1
), {name}_cut AS (
  SELECT r, i, CASE WHEN i > coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -{width}) + {width} THEN 1 ELSE 0 END AS fresh FROM {name}_hit
), {name}_run AS (
  SELECT r, min(i) AS s, max(i) + {width} AS e FROM (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS g FROM {name}_cut) GROUP BY r, g
)"""


SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents
), {_runs_sql(WIDTH, "long")}, {_runs_sql(REPORT, "short")}, piece AS (
  SELECT r, s, b[coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 1) : s - 1] AS p FROM long_run JOIN d USING (r)
  UNION ALL SELECT r, 1000000000000, b[last : octet_length(b)] FROM (SELECT r, max(e) AS last FROM long_run GROUP BY r) JOIN d USING (r)
), kept AS (
  SELECT r, unhex(string_agg(hex(p), '' ORDER BY s)) AS k FROM piece GROUP BY r
), gone AS (
  SELECT r, sum(e - s) AS n, count(*) AS c FROM long_run GROUP BY r
), again AS (
  SELECT r, sum(e - s) AS n FROM short_run GROUP BY r
)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed, CAST(coalesce(gone.c, 0) AS BIGINT) AS n_spans,
       sha256(coalesce(k, b)) AS kept_sha256, CAST(coalesce(again.n, 0) AS BIGINT) AS n_repeated
FROM d LEFT JOIN kept USING (r) LEFT JOIN gone USING (r) LEFT JOIN again USING (r)
"""
