r"""Near-duplicate groups by circulant MinHash.

One permutation scatters the hashed shingles over 2**22 places, a second one, shifted circularly by k, gives
coordinate k of the signature: all coordinates come from one table row for each shingle.  160 coordinates make
32 bands of 5; two sets with a Jaccard similarity of 0.8 miss each other in all bands with probability 3e-6.

Texts with equal shingle sets form one class and go on as one row.  Inside a bucket no lists of pairs are made:

* Every member is verified against the bucket's pivot, the member whose buckets hold most, which in a group of
  near copies is close to what they were made from.  Most of a group is linked by that.
* What a member holds beyond its pivot is counted over all that were held against the same pivot.  A member that is
  not linked to the pivot and has a partner must share with it some shingles beyond the pivot that few have (fewer
  than ``COMMON``), or be so much like the pivot in all others that sizes and counts alone allow the link.  The
  first kind is found by the shingles that they share, the second by a bound; members that can reach the threshold
  with none leave the bucket.  Jaccard distance is a metric: members that are nearer to the pivot than ``FAR`` by
  a link's distance link with none beyond ``FAR``, so only members this side of ``FAR`` are counted.
* Those that are left meet further pivots in rounds, each class a few; then the pairs that no round has judged
  and the bounds allow are verified one by one, so that no link is lost.  There are no caps.

Links are exact: 100 * intersection >= threshold * union of the distinct shingles (64-bit hashes within a pair).

Defined results for odd input: a null or empty text has no shingles, links with nothing and stays; a text with
fewer words than a shingle is one shingle; repeated rows are one class; a null doc_id never names a component
that has another id; columns besides doc_id and text are not read; an empty table gives no rows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, free, keyed, slices, stored, texts
from .repeats import mix, same_row
from .substrings import word_units

BANDS, ROWS = 32, 5
PLACES = 1 << 22
PIVOTS = 4  # pairs to verify for each class and round
OPEN = 0.25  # open pairs for each bucket member at which rounds end
COMMON = 64  # members that hold a shingle from which on it tells nothing
FAR = 20  # percent of similarity to a pivot below which a member is not counted
U = np.uint64


def shingles(text: bytes, words: int = 2) -> np.ndarray:
    """Distinct hashed shingles in order."""
    h = mix(word_units(text.lower()))
    if not len(h):
        return h
    n = max(1, len(h) - words + 1)
    out = np.full(n, min(words, len(h)), U)
    for i in range(min(words, len(h))):
        out = mix(out * U(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(out)


@lru_cache(maxsize=1)
def _table(k: int) -> np.ndarray:
    """Row p: the second permutation at p, p + 1, ... p + k - 1, circularly; a view, so no copies."""
    p = np.random.default_rng(20240229).permutation(PLACES).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.append(p, p[: k - 1]), k)


def signature(found: np.ndarray, k: int = BANDS * ROWS) -> np.ndarray:
    places = ((found * U(0xD6E8FEB86659FD93)) >> U(64 - PLACES.bit_length() + 1)).astype(np.int64)
    table, least = _table(k), np.full(k, PLACES, np.uint32)
    for i in range(0, len(places), 4096):
        least = np.minimum(least, table[places[i : i + 4096]].min(axis=0))
    return least


def bands(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    s = sig.reshape(-1, rows).astype(U)
    out = np.arange(len(s), dtype=U)
    for i in range(rows):
        out = mix(out * U(0x9E3779B97F4A7C15) + s[:, i])
    return out


def _sketched(docs: DataFrame, words: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                sets = [shingles(t, words) for t in texts(part)]
                names = [int(mix(s).sum(dtype=U)).to_bytes(8, "little") + int(np.bitwise_xor.reduce(mix(s ^ U(0x5851F42D4C957F2D)))).to_bytes(8, "little") for s in sets]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column(part.schema.get_field_index("doc_id")),
                    "rk": part.column(part.schema.get_field_index("rk")),
                    "n": pa.array([len(s) for s in sets], pa.int64()),
                    "cid": pa.array(names, pa.binary()),
                    "bands": pa.array([bands(signature(s)).view(np.int64) if len(s) else [] for s in sets], pa.list_(pa.int64())),
                })

    return docs.select("doc_id", "rk", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, rk long, n long, cid binary, bands array<long>")


def _verified(pairs: DataFrame, held: DataFrame, words: int) -> DataFrame:
    """Pairs (x, y) with the size of their intersection, from sets made anew from the whole texts.

    Where ``many`` is true and x and y are as similar as ``FAR`` asks, ``more`` has the shingles of x that y lacks.
    """

    def run(batches):
        @lru_cache(maxsize=64)
        def made(text):
            return shingles(text, words)

        for batch in batches:
            for part in slices(batch, "tx", 1 << 19):
                both, more = [], []
                for a, b, many in zip(texts(part, "tx"), texts(part, "ty"), part.column(2).to_pylist(), strict=True):
                    a, b = made(a), made(b)
                    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                    shared = b[at] == a
                    both.append(n := int(shared.sum()))
                    more.append(a[~shared].view(np.int64) if many and 100 * n >= FAR * (len(a) + len(b) - n) else None)
                yield pa.RecordBatch.from_pydict({"x": part.column(0), "y": part.column(1), "both": pa.array(both, pa.int64()), "more": pa.array(more, pa.list_(pa.int64()))})

    x, y = held.select(F.col("cid").alias("x"), F.col("text").alias("tx")), held.select(F.col("cid").alias("y"), F.col("text").alias("ty"))
    return pairs.select("x", "y", "many").join(x, "x").join(y, "y").select("x", "y", "many", "tx", "ty").mapInArrow(run, "x binary, y binary, both long, more array<long>")


def components(edges: DataFrame, steps: int | None = None) -> DataFrame:
    """(node, label) of a graph of edges (x, y): each step takes the least label among neighbours and the own label's.

    With ``steps`` labels may not be final: nodes with one label are in one component, but not the other way round.
    """
    x, y = edges.select("x", "y"), edges.select(F.col("y").alias("x"), F.col("x").alias("y"))
    own = x.union(y).select("x", F.col("x").alias("y"))
    both = stored(x.union(y).union(own).distinct(), "edges")
    labels = stored(both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("label")), "labels")
    while True:
        of = labels.select(F.col("node").alias("y"), F.col("label").alias("ly"))
        hops = both.union(labels.select("node", "label")).join(of, "y")
        mine = F.max(F.when(F.col("x") == F.col("y"), F.col("ly")))
        new = stored(hops.groupBy(F.col("x").alias("node")).agg(F.min("ly").alias("label"), mine.alias("old")), "labels")
        dropped(labels)
        labels = new
        steps = steps and steps - 1
        if steps == 0 or not new.where("label <> old").limit(1).count():
            dropped(both)
            return labels


def _similar(both: Column, a: Column, b: Column, percent: int) -> Column:
    return 100 * both >= percent * (a + b - both)


def _bound(a: str, ca: str, b: str, cb: str, threshold: int) -> Column:
    """Whether sets of ``a`` and ``b`` shingles, of which only ``ca`` and ``cb`` can be shared, may link."""
    return _similar(F.least(ca, cb), F.col(a), F.col(b), threshold)


def _held_against_pivots(members: DataFrame, held: DataFrame, words: int, threshold: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """First round: (judged pairs x, y, linked; pairs x, y to verify; members b, cid, n, c that may link with others).

    ``c`` bounds what a member shares with one of its bucket that it is not to be verified with.
    """
    near = FAR + 100 - threshold
    reach = members.groupBy("cid").agg(F.sum("c").alias("reach"))
    pivots = stored(members.join(reach, "cid").groupBy("b", "c").agg(F.max(F.struct("reach", "cid", "n")).alias("p")).select("b", "c", F.col("p.cid").alias("p"), F.col("p.n").alias("np")), "pivots")
    met = members.drop("c").join(pivots, "b").where("cid <> p").groupBy("cid", "p").agg(F.max("n").alias("n"), F.max("np").alias("np"), (F.max("c") > 2).alias("many"))
    worth = F.when(F.col("many"), F.lit(FAR)).otherwise(F.lit(threshold))
    met = stored(met.where(100 * F.least("n", "np") >= worth * F.greatest("n", "np")).select(F.col("cid").alias("x"), F.col("p").alias("y"), "n", "np", "many"), "met")
    found = stored(_verified(met, held, words).join(met.drop("many"), ["x", "y"]), "held-against")
    dropped(met)
    similar = lambda percent: _similar(F.col("both"), F.col("n"), F.col("np"), percent)
    beyond = found.select("y", "x", (similar(near) & ~similar(threshold)).alias("stray"), F.explode("more").alias("e"))
    counts = stored(beyond.groupBy("y", "e").agg(F.count("*").alias("k"), F.max("stray").alias("any")).where("k > 1"), "beyond")
    common = beyond.join(counts.where(F.col("k") >= COMMON).select("y", "e"), ["y", "e"]).groupBy("y", "x").agg(F.count("*").alias("common"))
    rare = beyond.join(counts.where((F.col("k") < COMMON) & F.col("any")).select("y", "e"), ["y", "e"])
    least = found.where(similar(FAR)).groupBy("y").agg(F.least(F.min("n"), F.min("np")).alias("least"))
    told = found.withColumn("beyond", F.when(F.col("more").isNotNull(), F.size("more")).otherwise(0)).drop("more").join(common, ["y", "x"], "left").join(least, "y", "left")
    told = told.withColumn("c", F.col("n") - F.col("beyond") + F.coalesce("common", F.lit(0)))
    # Of partners as small as any at hand, and as a link allows, and no smaller than what they share.
    other = F.greatest("least", F.ceil(threshold * F.col("n") / 100), "c")
    # Only these have been counted whole.
    told = told.withColumn("known", similar(near) & F.col("least").isNotNull())
    told = told.withColumn("done", F.col("known") & ~_similar(F.col("c"), F.col("n"), other, threshold)).withColumn("all", F.col("c")).withColumn("c", F.when(F.col("known"), F.col("c")).otherwise(F.col("n")))
    told = stored(told.select("x", "y", similar(threshold).alias("linked"), "n", "all", "c", "done"), "told")
    # Members of a pair share at most what c bounds and the rare shingles that both hold.
    shared = rare.where("stray").select("y", "e", "x").join(rare.select("y", "e", F.col("x").alias("z")), ["y", "e"]).where("x <> z").groupBy("y", "x", "z").agg(F.count("*").alias("h"))
    own = told.select("y", "x", F.col("n").alias("nx"), F.col("all").alias("cx"))
    shared = shared.join(own, ["y", "x"]).join(own.select("y", F.col("x").alias("z"), F.col("nx").alias("nz"), F.col("cx").alias("cz")), ["y", "z"])
    shared = shared.where(_similar(F.least("cx", "cz") + F.col("h"), F.col("nx"), F.col("nz"), threshold))
    pairs = stored(shared.select(F.least("x", "z").alias("x"), F.greatest("x", "z").alias("y"), F.lit(False).alias("many")).distinct(), "rare-pairs")
    dropped(found, counts)
    bound = told.select(F.col("x").alias("cid"), F.col("y").alias("p"), F.col("c").alias("k"), "done")
    left = members.drop("c").join(pivots.where("c > 2").select("b", "p"), "b").join(bound, ["cid", "p"], "left").where(~F.coalesce("done", F.lit(False)))
    return told, pairs, left.select("b", "cid", "n", F.coalesce("k", "n").alias("c"))


def classes_of(docs: DataFrame, words: int = 5, threshold: int = 80) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, rk, n, cid; classes: cid, label of the group, component_id, one (z, doc_id, rk) of the least row)."""
    spark = docs.sparkSession
    docs = keyed(docs)
    rows = stored(_sketched(docs, words), "sketches")
    full = rows.where("n > 0")
    one = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "rk")).alias("one")
    classes = stored(full.groupBy("cid").agg(F.min("doc_id").alias("least"), one, F.first("n").alias("n"), F.first("bands").alias("bands")), "classes")
    slots = classes.select(F.explode("bands").alias("b"), "cid", "n")
    hot = slots.groupBy("b").agg(F.count("*").alias("c")).where("c > 1")
    members = stored(slots.join(hot, "b"), "members")
    nodes = members.select("cid").distinct()
    first = classes.join(nodes, "cid").select("cid", "one.*")
    held = stored(docs.join(first, same_row(docs, first)).select("cid", "text").dropDuplicates(["cid"]), "held")
    judged, pairs, left = _held_against_pivots(members, held, words, threshold)
    left = stored(left, "members")
    dropped(members)
    links, done = judged.where("linked").select("x", "y"), judged.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    if pairs.limit(1).count():
        new = _linked(pairs.join(done, ["x", "y"], "left_anti"), held, classes, words, threshold)
        links, done = links.union(new.where("linked").select("x", "y")), done.union(new.select("x", "y"))
    labels, before, seed = components(links, steps=2), None, 0
    while True:
        now = left.join(labels.select(F.col("node").alias("cid"), "label"), "cid", "left").withColumn("g", F.coalesce("label", "cid")).drop("label")
        # Buckets that one group fills have nothing left to say.
        mixed = now.groupBy("b").agg(F.min("g").alias("g0"), F.max("g").alias("g1")).where("g0 <> g1").select("b")
        now = stored(now.join(mixed, "b"), "members")
        open_ = _open_count(now)
        if not open_ or open_ <= OPEN * now.count() or before is not None and open_ > before / 2:
            break
        before = open_
        pivots = now.groupBy("b").agg(F.min_by(F.struct("cid", "n", "c", "g"), F.xxhash64("cid", F.lit(seed))).alias("p")).select("b", F.col("p.cid").alias("y"), F.col("p.n").alias("ny"), F.col("p.c").alias("cy"), F.col("p.g").alias("gy"))
        pairs = now.join(pivots, "b").where((F.col("g") != F.col("gy")) & _bound("n", "c", "ny", "cy", threshold))
        pairs = pairs.select(F.least("cid", "y").alias("x"), F.greatest("cid", "y").alias("y"), "cid").groupBy("x", "y", "cid").agg(F.count("*").alias("c"))
        pairs = pairs.join(done, ["x", "y"], "left_anti")
        # At most one pivot for each band, so the list is short; pivots that wait stay open.
        best = pairs.groupBy("cid").agg(F.slice(F.sort_array(F.collect_list(F.struct("c", "x", "y")), asc=False), 1, PIVOTS).alias("m"))
        best = best.select(F.explode("m").alias("m")).select("m.x", "m.y", F.lit(False).alias("many")).distinct()
        new = _linked(best, held, classes, words, threshold)
        done = done.union(new.select("x", "y"))
        new = new.where("linked").select("x", "y")
        if not new.limit(1).count():
            break
        links = links.union(new)
        # Labels short of final only leave more pairs open.
        dropped(left, labels)
        labels, left, seed = components(links, steps=2), now.drop("g"), seed + 1
    if open_:
        links = links.union(_linked(_open_pairs(now, done, threshold), held, classes, words, threshold).where("linked").select("x", "y"))
    dropped(labels)
    labels = components(links)
    of = classes.select("cid", "least", "one").join(labels.select(F.col("node").alias("cid"), "label"), "cid", "left")
    lowest = of.where("label is not null").groupBy("label").agg(F.min("least").alias("lowest"))
    of = stored(of.join(lowest, "label", "left").select("cid", F.coalesce("label", "cid").alias("label"), F.coalesce("lowest", "least").alias("component_id"), "one"), "groups")
    dropped(held, left, now, classes, labels)
    return rows.select("doc_id", "rk", "n", "cid"), of


def _linked(pairs: DataFrame, held: DataFrame, classes: DataFrame, words: int, threshold: int) -> DataFrame:
    """(x, y, linked) of pairs, stored."""
    found = _verified(pairs, held, words).select("x", "y", "both")
    n = lambda c, to: classes.select(F.col("cid").alias(c), F.col("n").alias(to))
    return stored(found.join(n("x", "nx"), "x").join(n("y", "ny"), "y").select("x", "y", _similar(F.col("both"), F.col("nx"), F.col("ny"), threshold).alias("linked")), "judged")


def _open_count(now: DataFrame) -> int:
    """Pairs in one bucket but different groups, counted from the sizes alone."""
    sizes = now.groupBy("b", "g").agg(F.count("*").alias("n")).groupBy("b").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("s"))
    return int(sizes.agg(F.coalesce(F.sum((F.col("n") * F.col("n") - F.col("s")) / 2), F.lit(0))).first()[0])


def _open_pairs(now: DataFrame, done: DataFrame, threshold: int) -> DataFrame:
    """Pairs in one bucket but different groups that the bounds allow and no round has judged.

    Members of a bucket's largest group are met only by those outside it, so a bucket costs the product of the two.
    """
    sizes = now.groupBy("b", "g").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("b").agg(F.count("*").alias("groups"), F.max_by("g", "n").alias("main")).where("groups > 1").select("b", "main")
    every = now.join(mixed, "b")
    left = every.where(F.col("g") != F.col("main"))
    right = every.select("b", F.col("cid").alias("y"), F.col("n").alias("ny"), F.col("c").alias("cy"), F.col("g").alias("gy"), (F.col("g") == F.col("main")).alias("inside"))
    pairs = left.join(right, "b").where((F.col("g") != F.col("gy")) & (F.col("inside") | (F.col("cid") < F.col("y"))) & _bound("n", "c", "ny", "cy", threshold))
    return pairs.select(F.least("cid", "y").alias("x"), F.greatest("cid", "y").alias("y"), F.lit(False).alias("many")).distinct().join(done, ["x", "y"], "left_anti")


def grouped(docs: DataFrame, words: int = 5, threshold: int = 80) -> DataFrame:
    """doc_id, rk, n (set size), cid (class), label (group) and component_id of every row."""
    rows, of = classes_of(docs, words, threshold)
    out = rows.join(of.drop("one"), "cid", "left")
    return out.withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))


def deduplicated(docs: DataFrame, words: int = 5, threshold: int = 80) -> DataFrame:
    """``docs`` with one row of each group: the one with the least doc_id; texts without words all stay."""
    _, of = classes_of(docs, words, threshold)
    rk = free(docs, "rk")
    first = of.groupBy("label").agg(F.min("one").alias("m")).select(F.col("m.doc_id").alias("doc_id"), F.col("m.rk").alias(rk))
    k = docs.withColumn(rk, F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    blank = F.length(F.translate(F.coalesce("text", F.lit("")), " \t\n\x0b\x0c\r", "")) == 0
    kept = k.where(~blank)
    kept = kept.join(first, (kept[rk] == first[rk]) & kept["doc_id"].eqNullSafe(first["doc_id"]), "left_semi").dropDuplicates(["doc_id", rk])
    return kept.select(docs.columns).union(docs.where(blank).select(docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = grouped(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=2)
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT r, CASE WHEN len(ws) > 1 THEN ws[i] || ' ' || ws[i + 1] ELSE ws[1] END AS x
  FROM (SELECT r, ws, unnest(range(1, greatest(len(ws), 2))) AS i FROM d WHERE len(ws) > 0)
), n AS (
  SELECT r, count(*) AS n FROM s GROUP BY r
), sized AS (
  SELECT r, x, n FROM s JOIN n USING (r)
), pair AS (
  SELECT a.r AS a, b.r AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM sized a JOIN sized b ON a.x = b.x AND a.r < b.r AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n GROUP BY a.r, b.r
), link AS (
  SELECT a, b FROM pair WHERE 100 * c >= 80 * (na + nb - c) UNION ALL SELECT b, a FROM pair WHERE 100 * c >= 80 * (na + nb - c)
), reach AS (
  SELECT r AS a, r AS b FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
), comp AS (
  SELECT reach.a AS r, min(d.doc_id) AS component_id FROM reach JOIN d ON reach.b = d.r GROUP BY reach.a
)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM d LEFT JOIN n USING (r) JOIN comp USING (r)
"""
