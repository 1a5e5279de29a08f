r"""Substring dedup by compacting a De Bruijn graph of word k-mers.

Edges are the 35-word windows of all texts.  A row for each would be a row for each word of the corpus, so windows
travel as super-k-mers, runs of windows with one minimizer (the least hash among their 11-word runs).  Minimizers
that occur once have no repeated window and end there; where the windows of one minimizer part, runs are cut to
finer grids and at last to single k-mers, so that what is left is the repeated part of the graph.  Spark joins count
its degrees and compact its nonbranching paths (``graph``).  Every path keeps its source coordinates (row, first and
last word), and the words there are read again: all occurrences of a path must have one digest.  Should they not,
64-bit names have collided, and all is named anew with another salt.

Defined results for odd input: a null or empty text has no words, loses none and hashes as the empty string;
repeated rows repeat each other's windows and lose them; a null doc_id is a value like any other; columns
besides doc_id and text are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import graph, repeats
from .common import dropped, free, keyed, slices, stored, texts

WIDTH = 35
SALTS = 4


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def word_units(text: bytes) -> np.ndarray:
    return np.fromiter(map(_words.__getitem__, text.split()), np.uint64)


def kind(width: int = WIDTH, salt: int = 0) -> repeats.Kind:
    units = word_units
    if salt:
        units = lambda text: repeats.mix(word_units(text) + np.uint64(salt))
    return repeats.Kind(width, max(1, width // 3), tuple(g for g in (5, 1) if g <= width), units)


def _cut(words: list[bytes], spans: list[tuple[int, int]]) -> tuple[list[bytes], int]:
    keep, at, gone = [], 0, 0
    for s, e in spans:
        keep += words[at:s]
        gone += e - s
        at = e
    return keep + words[at:], gone


def _cut_text(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and the white space after each; the rest stays as it is."""
    import re

    starts = [m.start() for m in re.finditer(rb"[^\x20\x09-\x0D]+", text)] + [len(text)]
    out, at = [], 0
    for s, e in spans:
        out.append(text[at : starts[s]])
        at = starts[e]
    out.append(text[at:])
    return b"".join(out).rstrip()


def _digest(docs: DataFrame) -> DataFrame:
    """Every row as if nothing were removed."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                words = [t.split() for t in texts(part)]
                cols = {n: part.column(part.schema.get_field_index(n)) for n in ("doc_id", "rk")}
                yield pa.RecordBatch.from_pydict(cols | {"n_words": pa.array(map(len, words), pa.int64()), "sha": [hashlib.sha256(b" ".join(w)).hexdigest() for w in words]})

    return docs.select("doc_id", "rk", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, rk long, n_words long, sha string")


def _removed(lists: DataFrame) -> DataFrame:
    """Texts without the words of their spans, and what the words of each span hash to."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                spans = part.column(part.schema.get_field_index("spans"))
                got = []
                for i, t in enumerate(texts(part)):
                    path, s, e = (np.asarray(c, np.int64) for c in spans[i].values.flatten())
                    words, gone = t.split(), repeats.runs(s, e)
                    said = [hashlib.blake2b(b" ".join(words[x:y]), digest_size=16).digest() for x, y in zip(s.tolist(), e.tolist(), strict=True)]
                    keep, n = _cut(words, gone)
                    got.append((n, hashlib.sha256(b" ".join(keep)).hexdigest(), _cut_text(t, gone), [{"path": p, "said": x} for p, x in zip(path.tolist(), said, strict=True)]))
                cols = {n: part.column(part.schema.get_field_index(n)) for n in ("doc_id", "rk")}
                yield pa.RecordBatch.from_pydict(cols | {
                    "n_removed": pa.array([g[0] for g in got], pa.int64()),
                    "kept_sha256": [g[1] for g in got],
                    "kept_text": pa.array([g[2].decode("utf-8", "replace") for g in got], pa.string()),
                    "sources": pa.array([g[3] for g in got], pa.list_(pa.struct([("path", pa.int64()), ("said", pa.binary())]))),
                })

    return lists.mapInArrow(run, f"doc_id {lists.schema['doc_id'].dataType.simpleString()}, rk long, n_removed long, kept_sha256 string, kept_text string, sources array<struct<path:long,said:binary>>")


def removed(docs: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """(keyed documents, one row for each key that loses words: n_removed, kept_sha256, kept_text)."""
    docs = keyed(docs)
    for salt in range(SALTS):
        held, units = repeats.find(docs, kind(width, salt))
        out = stored(_removed(repeats.with_texts(held, graph.compacted(units, width, repeats.KEYS), "spans")), "removed")
        dropped(held, units)
        said = out.select(F.explode("sources").alias("x")).groupBy("x.path").agg(F.min("x.said").alias("a"), F.max("x.said").alias("b"))
        if not said.where("a <> b").limit(1).count():
            return docs, out.drop("sources")
        dropped(out)
    raise RuntimeError(f"names of different words collide under {SALTS} salts")


def deduplicated(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` with the text that stays (and n_chars where there is such a column)."""
    rk, left = free(docs, "rk"), free(docs, "kept_text")
    k = docs.withColumn(rk, F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    _, cut = removed(docs, width)
    cut = cut.select(F.col("doc_id").alias("d"), F.col("rk").alias("r"), F.col("kept_text").alias(left))
    out = k.join(cut, (k[rk] == cut["r"]) & k["doc_id"].eqNullSafe(cut["d"]), "left").select(k["*"], cut[left])
    text = F.coalesce(left, "text")
    new = {"text": text} | ({"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.withColumns(new).select(docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, cut = removed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    every = _digest(docs)
    cut = cut.drop("kept_text")
    return every.join(cut, repeats.same_row(every, cut), "left").select(
        every["doc_id"], "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256")
    )


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT r, i, array_to_string(ws[i : i + 34], ' ') AS s FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM d WHERE len(ws) >= 35)
), hit AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY s) AS c FROM g) WHERE c > 1
), cov AS (
  SELECT DISTINCT r, i + o AS j FROM hit, (SELECT unnest(range(0, 35)) AS o)
), word AS (
  SELECT r, j, ws[j] AS w FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS j FROM d)
), kept AS (
  SELECT word.r, string_agg(w, ' ' ORDER BY word.j) AS t FROM word ANTI JOIN cov ON word.r = cov.r AND word.j = cov.j GROUP BY word.r
), gone AS (
  SELECT r, count(*) AS n FROM cov GROUP BY r
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r) LEFT JOIN gone USING (r)
"""
