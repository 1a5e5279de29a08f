r"""Line-first quality rules, DataFrame functions only.

Every line is judged by itself (navigation bars, symbol noise, shouting, boilerplate phrases, stubs
without closing punctuation); lines that fail go, then a document is rejected if it loses too much of its
text or fails the length and repetition rules of its own.

Defined results for odd input: a null or empty text has no words and no lines and fails the length rule;
columns besides ``text`` are passed through, those that clash with an output name give way to it; repeated
rows are judged one by one and alike.  Windows are compared as strings, so there are no hash collisions.
There is no shuffle: a plan is one scan and two projections, whatever the size of the input.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE

#: Phrases that mark a line as site furniture. Fixed values.
BOILERPLATE = (
    "all rights reserved",
    "cookie policy",
    "privacy policy",
    "terms of service",
    "terms of use",
    "enable javascript",
    "sign up for our newsletter",
    "click here to subscribe",
    "share this article",
    "skip to content",
    "alle rechte vorbehalten",
    "datenschutzerklärung",
    "nutzungsbedingungen",
    "newsletter abonnieren",
    "zum inhalt springen",
    "tous droits réservés",
    "politique de confidentialité",
    "conditions générales",
    "aller au contenu",
    "todos los derechos reservados",
    "política de privacidad",
    "términos de uso",
    "saltar al contenido",
)


#: Lines with more words than this are prose that mentions such a phrase.
FURNITURE_WORDS = 25
#: Characters that count as symbols, and those that close a line. Fixed values.
MARKS = "#*$%&|<>"
CLOSING = ".!?:;…\"')]»“”’。！？"


@dataclass(frozen=True)
class Rules:
    """Limits of the rules; shares are of a line's words unless said otherwise."""

    min_words: int = 50
    max_repeat_share: int = 50  # per cent of the document's words in repeated 3-word windows
    nav_marks: float = 0.3  # '|' per word
    symbols: float = 0.3  # of #*$%&<> per word
    shouts: float = 0.3  # '!!' per word
    stub_words: int = 3  # a line without closing punctuation fails with fewer words
    max_lost: float = 0.5  # share of the document's word characters that failing lines may hold


def measured(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``docs`` with the measures, ``base_failed``, ``kept``, ``lost_share`` and ``clean_text`` (lines that passed)."""
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_text", "lost_share"]
    own = [c for c in docs.columns if c.lower() not in new]
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    # Each step uses the one before more than once, so that the optimizer keeps it as a step of its own.
    a = docs.select(*[F.col(f"`{c}`") for c in own], F.transform(F.split(text, "\n"), _split).alias("__l"))
    a = a.withColumns({"__w": F.flatten(F.transform("__l", lambda x: x["words"])), "__j": F.transform("__l", _judged)})
    a = a.withColumns({"n_words": F.size("__w").cast("long"), "__h": _hashes(F.col("__w"))})
    a = a.withColumn("__s", F.when(F.size(F.array_distinct("__h")) < F.size("__h"), F.sort_array(_packed(F.col("__h")))))
    a = a.withColumn("__c", F.when(F.col("__s").isNotNull(), _windows(F.col("__w"), _candidates(F.col("__s")))))
    total = lambda xs, field: F.aggregate(xs, F.lit(0).cast("long"), lambda n, x: n + x[field])
    lines = F.transform(F.filter("__j", lambda x: x["n"] > 0), lambda x: x["line"])
    a = a.withColumns({
        "word_chars": total("__j", "chars"),
        "n_symbols": total("__j", "marks"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": F.coalesce(_covered(F.col("__c")), F.lit(0)).cast("long"),
        "__passed": F.filter("__j", lambda x: ~_fails(x, rules)),
    })
    a = a.withColumns({
        "lost_share": F.when(F.col("word_chars") > 0, 1 - total("__passed", "chars") / F.col("word_chars")).otherwise(F.lit(0.0)),
        "base_failed": (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_share * F.col("n_words")),
        "clean_text": F.array_join(F.transform("__passed", lambda x: x["line"]), "\n"),
    })
    a = a.withColumn("kept", ~F.col("base_failed") & (F.col("lost_share") <= rules.max_lost))
    return a.select(*[F.col(f"`{c}`") for c in own], *new)


def cleaned(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``docs`` that the rules keep, with the lines that passed as text (and n_chars where there is such a column)."""
    # The caller's columns go in one struct, out of the way of the names of the measures.
    more = [c for c in docs.columns if c != "text"]
    row = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in more]).alias("__row")) if more else docs.select("text")
    # A filter would be pushed through all the steps, copying their expressions into each other without end;
    # one that needs a row number stays where it is.
    found = measured(row, rules).withColumn("__at", F.monotonically_increasing_id())
    found = found.where(F.col("kept") & (F.col("__at") >= 0))
    new = {"text": F.col("clean_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("clean_text").cast(docs.schema["n_chars"].dataType)
    return found.select(*[new[c].alias(c) if c in new else F.col("__row")[c].alias(c) for c in docs.columns])


def _split(line: Column) -> Column:
    return F.struct(line.alias("line"), F.filter(F.split(line, "[ \\t-\\r]+"), lambda w: w != "").alias("words"))


def _judged(x: Column) -> Column:
    line, words = x["line"], x["words"]
    cut = lambda mark: F.length(line) - F.length(F.replace(line, F.lit(mark), F.lit("")))
    return F.struct(
        line.alias("line"),
        F.size(words).alias("n"),
        F.length(F.array_join(words, "")).cast("long").alias("chars"),
        cut("|").alias("bars"),
        F.when(line.rlike(f"[{MARKS}]"), F.length(line) - F.length(F.translate(line, MARKS, ""))).otherwise(0).alias("marks"),
        (cut("!!") / 2).alias("shouts"),
        (F.instr(F.lit(CLOSING), F.right(F.rtrim(line, F.lit(SPACE)), F.lit(1))) > 0).alias("closed"),
        ((F.size(words) <= FURNITURE_WORDS) & F.lower(line).rlike("|".join(BOILERPLATE))).alias("furniture"),
    )


def _fails(x: Column, r: Rules) -> Column:
    n, symbols = x["n"], x["marks"] - x["bars"]
    return (n > 0) & (
        ((x["bars"] >= 3) & (x["bars"] >= r.nav_marks * n))
        | ((symbols >= 3) & (symbols > r.symbols * n))
        | ((x["shouts"] >= 2) & (x["shouts"] > r.shouts * n))
        | (~x["closed"] & (n < r.stub_words))
        | x["furniture"]
    )


#: Low bits of a packed window hold its place: more than the words that a text of 2 GB can have.
PLACE_BITS = 30


def _hashes(words: Column) -> Column:
    every = F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    return F.slice(every, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0)))


def _packed(hashes: Column) -> Column:
    """For each 3-word window 34 bits of its hash above its place, as a long: such arrays sort as primitives."""
    return F.transform(hashes, lambda h, i: F.shiftleft(h, PLACE_BITS).bitwiseOR(i.cast("long")))


def _candidates(s: Column) -> Column:
    """Places of windows whose hash bits equal those of a neighbour: all repeated windows, and perhaps others."""
    same = F.filter(F.transform(s, lambda x, i: F.when(F.shiftright(x.bitwiseXOR(F.get(s, i + 1)), PLACE_BITS) == 0, i)), lambda i: i.isNotNull())
    both = F.array_distinct(F.flatten(F.transform(same, lambda i: F.array(i, i + 1))))
    return F.transform(both, lambda i: F.get(s, i).bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int"))


def _windows(words: Column, places: Column) -> Column:
    """(window, place) in order: the windows themselves are compared, so hashes that collide do no harm."""
    return F.sort_array(F.transform(places, lambda i: F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("p"))))


def _covered(s: Column) -> Column:
    """Words under windows that equal a neighbour in the sorted list."""
    same = F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["w"] == x["w"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["w"] == x["w"], F.lit(False)))
    places = F.sort_array(F.transform(same, lambda x: x["p"]))
    first = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    return F.aggregate(places, first, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")), lambda a: a["n"])


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return measured(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_FURNITURE = "|".join(BOILERPLATE)
SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, string_split(text, chr(10)) AS ls FROM d
), m AS (
  SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), dup AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM m) WHERE c >= 2
), cov AS (
  SELECT r, count(DISTINCT i + o) AS n_repeat_words FROM dup, (SELECT unnest([0, 1, 2]) AS o) GROUP BY r
), l AS (
  SELECT r, line, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars,
         regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw FROM (SELECT r, unnest(ls) AS line FROM w)
), j AS (
  SELECT *, len(lw) AS n, length(line) - length(replace(line, '|', '')) AS bars,
         length(line) - length(regexp_replace(line, '[#*$%&<>]', '', 'g')) AS symbols,
         len(regexp_extract_all(line, '!!')) AS shouts,
         regexp_matches(line, '[.!?:;…"'')\]»“”’。！？][\x20\x09-\x0D]*$') AS closed,
         len(lw) <= 25 AND regexp_matches(lower(line), '{_FURNITURE}') AS furniture FROM l
), k AS (
  SELECT r, count(*) FILTER (WHERE chars > 0) - count(DISTINCT line) FILTER (WHERE chars > 0) AS n_dup_lines,
         coalesce(sum(chars) FILTER (WHERE NOT (n > 0 AND ((bars >= 3 AND bars >= 0.3 * n) OR (symbols >= 3 AND symbols > 0.3 * n)
           OR (shouts >= 2 AND shouts > 0.3 * n) OR (NOT closed AND n < 3) OR furniture))), 0) AS held
  FROM j GROUP BY r
), f AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, held
  FROM w LEFT JOIN k USING (r) LEFT JOIN cov USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
         AND (CASE WHEN word_chars > 0 THEN 1 - CAST(held AS DOUBLE) / word_chars ELSE 0 END) <= 0.5 AS kept
FROM f
"""
