"""Windows of ``width`` units (words or bytes) that start more than once in a corpus, without a row per window.

Each window is filed under an anchor, a place that its content alone decides; neighbouring windows with one
anchor make a piece, and pieces are what travels:

* ``k`` names the context that all windows of a piece share.  Windows can be equal only if their ``k`` is, so
  pieces whose ``k`` occurs once are done: most of a corpus ends here.
* ``f`` names the whole stretch under a piece.  Pieces with equal ``k`` and ``f`` are the same stretch, all of
  whose windows repeat: a long copied passage is settled in a few rows for each copy.
* What is left, pieces that share a context and then part, is cut into cells of fewer windows, which share
  more context, down to single windows.  Of pieces that are the same stretch, one goes on for all.

Names are 64-bit polynomial hashes with separate bases; a decision needs both, so 128 bits.  Groups are
counted by partial aggregation and joined back, so a context that a third of all documents hold is a skewed
join at worst, which Spark splits, and never a list in one task.  A bit map keeps pieces whose context is not
repeated out of that join.  Stretches are judged on the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bitmap import bit_map, passing
from .common import dropped, slices, stored, texts

U = np.uint64
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)  # odd, so they have inverses modulo 2**64
PLACE = U((1 << 28) - 1)
SEGMENT = 1 << 18  # units worked on at once
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


@dataclass(frozen=True)
class Kind:
    """What a unit is and how windows are filed.

    ``context``: units that anchors are known by; ``grids``: windows to a cell at each later level, the last 1;
    ``units``: a text's units as 64-bit values; ``trigger``: 0, or one place in so many is a phrase boundary,
    known by a rolling hash of ``trigger_units``, and the first boundary in a window is its anchor.
    """

    width: int
    context: int
    grids: tuple[int, ...]
    units: Callable[[bytes], np.ndarray]
    trigger: int = 0
    trigger_units: int = 16


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _tables.get(base)
    if have is None or len(have[0]) < n:
        n = max(n, 1 << 16)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(n, b, U)
            p[0] = 1
            both.append(np.cumprod(p, dtype=U))
        have = _tables[base] = (both[0], both[1])
    return have


class Names:
    """Hashes of any stretch of a unit array."""

    def __init__(self, x: np.ndarray):
        self.sums = []
        for i, base in enumerate(BASES):
            p, _ = _powers(base, len(x) + 1)
            s = np.zeros(len(x) + 1, U)
            np.cumsum((mix(x) if i else x) * p[: len(x)], dtype=U, out=s[1:])
            self.sums.append(s)

    def of(self, i: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        _, inverse = _powers(BASES[i], len(self.sums[i]))
        return (self.sums[i][end] - self.sums[i][start]) * inverse[start]


def _least(v: np.ndarray, n: int) -> np.ndarray:
    """Least value of each run of n neighbours."""
    size = 1
    while size * 2 <= n:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    return np.minimum(v[: len(v) - (n - size)], v[n - size :]) if n > size else v


def anchors(kind: Kind, names: Names, n: int) -> np.ndarray:
    """Anchor of the window at each start."""
    place = np.arange(n - kind.context + 1, dtype=np.int64)
    v = mix(names.of(0, place, place + kind.context))
    v = (v & ~PLACE) | place.astype(U)
    if kind.trigger:
        roll = mix(names.of(0, place, place + kind.trigger_units))
        v = np.where(roll % U(kind.trigger) == 0, place.astype(U), v | U(1 << 63))
    return (_least(v, kind.width - kind.context + 1)[: n - kind.width + 1] & PLACE).astype(np.int64)


def first_pieces(kind: Kind, x: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(k, f, anchor, lo, hi): windows start at anchor - hi ... anchor - lo."""
    w = kind.width
    for begin in range(0, len(x) - w + 1, SEGMENT):
        part = x[begin : begin + SEGMENT + w - 1]
        names = Names(part)
        a = anchors(kind, names, len(part))
        cut = np.flatnonzero(a[1:] != a[:-1])
        s0, s1 = np.append(0, cut + 1), np.append(cut, len(a) - 1)
        a = a[s0]
        yield _named(names, w, a, a - s1, a - s0, begin, a, a + kind.context, np.zeros_like(a))


def _named(names: Names, w: int, a, lo, hi, begin: int, c0, c1, cell) -> tuple[np.ndarray, ...]:
    # Anchors are least hashes of contexts; mixed once more, their names spread evenly again.
    k = mix(mix(names.of(0, c0, c1) + U(0xA24BAED4963EE407) * cell.astype(U)) ^ U(0x94D049BB133111EB))
    f = mix(names.of(1, a - hi, a - lo + w) + U(0x9FB21C651E98DF25) * (lo << 32 | hi).astype(U))
    return k.view(np.int64), f.view(np.int64), a + begin, lo, hi


def cells(kind: Kind, grid: int, x: np.ndarray, pieces: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Cut pieces (anchor, lo, hi) into cells of ``grid`` offsets and name those."""
    w = kind.width
    a, lo, hi = pieces.T
    first, last = lo // grid, hi // grid
    many = last - first + 1
    at = np.repeat(np.arange(len(a)), many)
    cell = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many) + first[at]
    a, lo, hi = a[at], np.maximum(lo[at], cell * grid), np.minimum(hi[at], cell * grid + grid - 1)
    begin = a - hi
    order = np.argsort(begin, kind="stable")
    a, lo, hi, cell, begin = a[order], lo[order], hi[order], cell[order], begin[order]
    for base in range(0, len(x), SEGMENT):
        i, j = np.searchsorted(begin, (base, base + SEGMENT))
        if i == j:
            continue
        left = max(0, base - 2 * w)
        names = Names(x[left : base + SEGMENT + 2 * w])
        b, c = a[i:j] - left, cell[i:j]
        yield _named(names, w, b, lo[i:j], hi[i:j], left, b - c * grid, b - (c * grid + grid - 1) + w, c)


KEYS = ("doc_id", "rk")


def _emit(part: pa.RecordBatch, found: list[tuple[int, tuple[np.ndarray, ...]]], keys: tuple[str, ...]) -> pa.RecordBatch:
    rows = pa.array(np.concatenate([np.full(len(t[0]), i) for i, t in found]) if found else np.zeros(0, np.int64))
    cols = [np.concatenate([t[c] for _, t in found]) if found else np.zeros(0, np.int64) for c in range(5)]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
    out = {n: pa.array(c).cast(t) for n, c, t in zip(("k", "f", "a", "lo", "hi"), cols, kinds, strict=True)}
    return pa.RecordBatch.from_pydict(out | {n: part.column(part.schema.get_field_index(n)).take(rows) for n in keys})


def _schema(docs: DataFrame, keys: tuple[str, ...]) -> str:
    return "k long, f long, a int, lo int, hi int" + "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in keys)


def _first(docs: DataFrame, kind: Kind, keys: tuple[str, ...]) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                yield _emit(part, [(i, t) for i, b in enumerate(texts(part)) for t in first_pieces(kind, kind.units(b))], keys)

    return docs.select(*keys, "text").mapInArrow(run, _schema(docs, keys))


def _refined(docs: DataFrame, kind: Kind, grid: int, keys: tuple[str, ...]) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                lists = part.column(part.schema.get_field_index("pieces"))
                found = []
                for i, b in enumerate(texts(part)):
                    flat = lists[i].values.flatten()
                    pieces = np.stack([np.asarray(c, np.int64) for c in flat], axis=1)
                    found += [(i, t) for t in cells(kind, grid, kind.units(b), pieces)]
                yield _emit(part, found, keys)

    return docs.select(*keys, "text", "pieces").mapInArrow(run, _schema(docs, keys))


def same_row(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = KEYS) -> Column:
    """Whether rows have one key; only ``doc_id``, the first column, can be null."""
    out = a[keys[0]].eqNullSafe(b[keys[0]])
    for c in keys[1:]:
        out &= a[c] == b[c]
    return out


def find(docs: DataFrame, kind: Kind, keys: tuple[str, ...] = KEYS) -> tuple[DataFrame, DataFrame]:
    """(texts of documents with a shared context; their repeated units: keys, ``units`` of s, n, u).

    ``docs`` has the columns ``keys``, which tell texts apart, and ``text``.  A unit is a run of ``n`` windows, the
    first of which starts at ``s``, that all repeat; ``u`` names its content.  Units of a document don't overlap
    in windows.
    """
    pieces = stored(_first(docs, kind, keys), "pieces")
    groups = lambda p: p.groupBy("k").agg(F.count("*").alias("c"), F.min("f").alias("f0"), F.max("f").alias("f1")).where("c > 1").select("k", (F.col("f0") == F.col("f1")).alias("same"))
    contexts = stored(groups(pieces), "contexts")
    bits = bit_map(contexts.select(F.col("k").alias("name")))
    shared = stored(passing(pieces, "k", bits).join(contexts, "k"), "shared")
    dropped(pieces, contexts)
    mine = shared.select(*keys).distinct()
    held = stored(docs.join(mine, same_row(docs, mine, keys), "left_semi").select(*(docs[c] for c in keys), "text").dropDuplicates(list(keys)), "texts")
    hits, scratch = [], [shared]
    for level in range(len(kind.grids) + 1):
        parted = shared.where(~F.col("same"))
        stretches = stored(parted.groupBy("k", "f").agg(F.count("*").alias("c"), F.min(F.struct(*keys, "a", "lo", "hi")).alias("one")), "stretches")
        scratch.append(stretches)
        again = stretches.where("c > 1").select("k", "f")
        hits += [(level, shared.where("same")), (level, parted.join(again, ["k", "f"], "left_semi"))]
        if level == len(kind.grids):
            break
        lists = stretches.select("one.*").groupBy(*keys).agg(F.collect_set(F.struct("a", "lo", "hi")).alias("pieces"))
        joined = held.join(lists, same_row(held, lists, keys)).select(*(held[c] for c in keys), "text", "pieces")
        pieces = stored(_refined(joined, kind, kind.grids[level], keys), "cells")
        shared = stored(pieces.join(groups(pieces), "k"), "shared")
        dropped(pieces)
        scratch.append(shared)
    out = None
    for level, h in hits:
        unit = F.struct((F.col("a") - F.col("hi")).alias("s"), (F.col("hi") - F.col("lo") + 1).alias("n"), F.xxhash64(F.lit(level), "k", "f").alias("u"))
        h = h.select(*keys, unit.alias("unit"))
        out = h if out is None else out.union(h)
    units = stored(out.groupBy(*keys).agg(F.collect_set("unit").alias("units")), "units")
    dropped(*scratch)
    return held, units


def with_texts(held: DataFrame, lists: DataFrame, column: str, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Texts with their list."""
    return held.join(lists, same_row(held, lists, keys)).select(*(held[c] for c in keys), "text", column)


def runs(s: np.ndarray, e: np.ndarray, gap: int = 0) -> list[tuple[int, int]]:
    """Maximal runs that stretches [s, e) cover, in order."""
    if not len(s):
        return []
    order = np.argsort(s, kind="stable")
    s, e = s[order], np.maximum.accumulate(e[order])
    cut = np.flatnonzero(s[1:] > e[:-1] + gap)
    return list(zip(s[np.append(0, cut + 1)].tolist(), e[np.append(cut, len(e) - 1)].tolist(), strict=True))
