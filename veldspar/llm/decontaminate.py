r"""Benchmark decontamination by the q-gram lemma and banded alignment.

A text within k edits of an item of n characters shares at least n - q + 1 - k * q of its q-grams with it, and
on diagonals (place in the text minus place in the item) that lie at most k apart.  Hits are counted in
overlapping diagonal bands, each twice as wide as the budget; bands that reach the bound are aligned exactly,
inside the band only.  An item's most frequent q-grams may be left out of the index if its bound is lowered by
as many, so nothing within the budget is lost.

Both sides are lower-cased and their white space collapsed.  Items are the stated query set: they are held in
blocks of at most ``block`` characters (a proven bound for what is broadcast), each block against all rows.

Items of fewer than ``LONG`` characters are searched with q-grams half as long, so that the bound bears the same rate
of edits; those of fewer than ``LEAST`` match whole and unchanged only, at word boundaries.

Defined results for odd input: null and empty texts match nothing; equal items each match; repeated rows match alike and give one row each
for an item; a null doc_id or item_id is kept as it is; columns besides id and text are not read.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free, slices, stored, texts
from .repeats import mix, same_row

Q = 8
RATE = 0.1  # edits for each character of an item
LEAST = 24
LONG = 64
BLOCK = 4_000_000
CHUNK = 1 << 18  # characters of text worked on at once
U = np.uint64
_WORD = re.compile(r"\w+|[^\w\s]")


def normal(text: str) -> str:
    return " ".join(text.replace("\0", " ").lower().split())


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def grams(c: np.ndarray, q: int = Q) -> np.ndarray:
    """Hashes of the q-grams; q is a power of two."""
    h = c.astype(U)
    size, base = 1, 0x9E3779B97F4A7C15
    while size < q:
        h = h[:-size] * U(pow(base, size, 1 << 64)) + h[size:] if len(h) > size else h[:0]
        size *= 2
    return mix(h)


class Index:
    """Items that are searched with one length of q-grams."""

    def __init__(self, items: list[tuple[object, str]], rate: float = RATE, q: int = Q):
        self.q = q
        self.ids = [i for i, _ in items]
        self.text = [points(t) for _, t in items]
        n = np.array([len(t) for t in self.text], np.int64)
        # At least five shared q-grams must be left, so short items have smaller budgets.
        self.budget = np.maximum(0, np.minimum((n * rate).astype(np.int64), (n - q + 1 - 5) // q))
        self.bound = n - q + 1 - self.budget * q
        self.width = np.maximum(16, self.budget)
        found = [grams(t, q) if len(t) >= LEAST else grams(t, q)[:0] for t in self.text]
        self.short: dict[int, dict[tuple[str, ...], list[int]]] = {}
        for i, (_, t) in enumerate(items):
            if len(t) < LEAST:
                words = tuple(_WORD.findall(t))
                self.short.setdefault(len(words), {}).setdefault(words, []).append(i)
        self.raw = [t for _, t in items]
        seen = Counter(x for g in found for x in g.tolist())
        hashes, item, place = [], [], []
        for i, g in enumerate(found):
            often = np.array([seen[x] for x in g.tolist()])
            order = np.argsort(-often, kind="stable")[: max(0, int(self.bound[i]) // 2)]
            drop = order[often[order] > 32]
            keep = np.setdiff1d(np.arange(len(g)), drop)
            self.bound[i] -= len(drop)
            hashes.append(g[keep]), item.append(np.full(len(keep), i)), place.append(keep)
        hashes, item, place = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (hashes, item, place))
        order = np.argsort(hashes, kind="stable")
        self.item, self.place = item[order], place[order]
        self.hash, self.start, self.count = np.unique(hashes[order].astype(U), return_index=True, return_counts=True)
        self.map = np.zeros(1 << 22, bool)
        self.map[(self.hash >> U(42)).astype(np.int64)] = True

    def regions(self, c: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, first and last diagonal) of bands with enough shared q-grams."""
        h = grams(c, self.q)
        j = np.flatnonzero(self.map[(h >> U(42)).astype(np.int64)])
        if not len(j) or not len(self.hash):
            return
        at = np.minimum(np.searchsorted(self.hash, h[j]), len(self.hash) - 1)
        ok = self.hash[at] == h[j]
        j, at = j[ok], at[ok]
        many = self.count[at]
        hit = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.start[at], many)
        item = self.item[hit]
        diagonal = np.repeat(j, many) - self.place[hit]
        band = diagonal // self.width[item] + (1 << 30)
        key, n = np.unique(np.concatenate([item << 32 | band, item << 32 | (band - 1)]), return_counts=True)
        key = key[n >= self.bound[key >> 32]]
        for i, b in zip((key >> 32).tolist(), ((key & 0xFFFFFFFF) - (1 << 30)).tolist(), strict=True):
            w = int(self.width[i])
            yield i, b * w, b * w + 2 * w - 1

    def align(self, i: int, c: np.ndarray, low: int, high: int) -> tuple[int, int] | None:
        """(edits, end in c) of the best alignment of the whole item on these diagonals, if within the budget."""
        item, k = self.text[i], int(self.budget[i])
        low, high = low - k, high + k
        d = np.arange(low, high + 1)
        far = len(item) + k + 1
        cost = np.where((d >= 0) & (d <= len(c)), 0, far)
        steps = np.arange(len(d))
        padded = np.concatenate([np.full(max(0, -low), 0xFFFFFFFF, np.uint32), c[max(0, low) : high + len(item) + 1]])
        padded = np.append(padded, np.full(max(0, high + len(item) + 1 - low - len(padded)), 0xFFFFFFFF, np.uint32))
        for r in range(len(item)):
            ahead = cost + (padded[r : r + len(d)] != item[r])
            skip = np.append(cost[1:] + 1, far)
            best = np.minimum(ahead, skip)
            cost = np.minimum.accumulate(best - steps) + steps
            if cost.min() > k:
                return None
        end = d + len(item)
        cost = np.where((end >= 0) & (end <= len(c)), cost, far)
        at = int(cost.argmin())
        return (int(cost[at]), int(end[at])) if cost[at] <= k else None

    def matches(self, docs: list[str]) -> Iterator[tuple[int, int, int, int]]:
        """(document, item, edits, end) of each match in normalized texts; overlapping bands may say one twice."""
        longest = max((len(t) for t in self.text), default=0)
        lap = 2 * longest + 64
        parts: list[tuple[int, int, str]] = []
        held = 0
        for n, t in enumerate(docs):
            if self.short:
                yield from ((n, i, 0, end) for i, end in self._whole(t))
            for s in range(0, max(1, len(t) - lap), CHUNK):
                parts.append((n, s, t[s : s + CHUNK + lap]))
                held += len(parts[-1][2])
                if held > CHUNK:
                    yield from self._joined(parts)
                    parts, held = [], 0
        yield from self._joined(parts)

    def _whole(self, text: str) -> Iterator[tuple[int, int]]:
        """(item, end) of short items that stand in the text."""
        found = [m.span() for m in _WORD.finditer(text)]
        words = [text[a:b] for a, b in found]
        for size, items in self.short.items():
            for j in range(len(words) - size + 1):
                for i in items.get(tuple(words[j : j + size]), ()):
                    if text[found[j][0] : found[j + size - 1][1]] == self.raw[i]:
                        yield i, found[j + size - 1][1]

    def _joined(self, parts: list[tuple[int, int, str]]) -> Iterator[tuple[int, int, int, int]]:
        if not parts:
            return
        c = points("\0".join(t for _, _, t in parts) + "\0")
        begin = np.cumsum([0] + [len(t) + 1 for _, _, t in parts])
        for i, low, high in self.regions(c):
            # The band may touch several documents; each is aligned by itself.
            a = max(0, int(np.searchsorted(begin, low, "right")) - 1)
            b = int(np.searchsorted(begin, high + len(self.text[i]), "right"))
            for p in range(a, min(b, len(parts))):
                got = self.align(i, c[begin[p] : begin[p + 1] - 1], low - int(begin[p]), high - int(begin[p]))
                if got:
                    yield parts[p][0], i, got[0], parts[p][1] + got[1]


class Block:
    """Items of any length."""

    def __init__(self, items: list[tuple[object, str]], rate: float = RATE):
        long = [i for i, (_, t) in enumerate(items) if not LEAST <= len(t) < LONG]
        short = [i for i, (_, t) in enumerate(items) if LEAST <= len(t) < LONG]
        self.ids = [i for i, _ in items]
        self.parts = [(at, Index([items[i] for i in at], rate, q)) for at, q in ((long, Q), (short, Q // 2)) if at]

    def matches(self, docs: list[str]) -> Iterator[tuple[int, int, int, int]]:
        for at, index in self.parts:
            yield from ((d, at[i], edits, end) for d, i, edits, end in index.matches(docs))


def blocks(benchmark: DataFrame, block: int = BLOCK) -> Iterator[list[tuple[object, str]]]:
    held, size = [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        t = normal(r.text or "")
        if not t:
            continue
        if held and size + len(t) > block:
            yield held
            held, size = [], 0
        held.append((r.item_id, t))
        size += len(t)
    if held:
        yield held


def matched(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block: int = BLOCK) -> DataFrame:
    """doc_id, rk, item_id, edits, end_char (in the normalized text) of the best match, one row for each row and item."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("rk", F.xxhash64("doc_id", "text"))
    kinds = {n: f.schema[n].dataType for f, n in ((docs, "doc_id"), (benchmark, "item_id"))}
    schema = f"doc_id {kinds['doc_id'].simpleString()}, rk long, item_id {kinds['item_id'].simpleString()}, edits int, end_char long"
    item_type = pa.int64() if kinds["item_id"].simpleString() == "bigint" else pa.int32() if kinds["item_id"].simpleString() == "int" else pa.string()
    out = None
    for held in blocks(benchmark, block):
        sent = spark.sparkContext.broadcast((uuid.uuid4().hex, held, rate))

        def run(batches, sent=sent):
            index = _index(sent)
            for batch in batches:
                for part in slices(batch):
                    best: dict[tuple[int, int], tuple[int, int]] = {}
                    for d, i, edits, end in index.matches([normal(t.decode("utf-8", "replace")) for t in texts(part)]):
                        best[d, i] = min(best.get((d, i), (edits, end)), (edits, end))
                    rows = pa.array([d for d, _ in best], pa.int64())
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": part.column(part.schema.get_field_index("doc_id")).take(rows),
                        "rk": part.column(part.schema.get_field_index("rk")).take(rows),
                        "item_id": pa.array([index.ids[i] for _, i in best], item_type),
                        "edits": pa.array([e for e, _ in best.values()], pa.int32()),
                        "end_char": pa.array([e for _, e in best.values()], pa.int64()),
                    })

        found = docs.select("doc_id", "rk", "text").mapInArrow(run, schema)
        out = found if out is None else out.union(found)
    return out if out is not None else spark.createDataFrame([], schema)


_made: dict[str, Block] = {}


def _index(sent) -> Block:
    """The index of a block, made once in each worker; the key travels with the block, as addresses are used again."""
    key, items, rate = sent.value
    if key not in _made:
        _made.clear()
        _made[key] = Block(items, rate)
    return _made[key]


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item."""
    rk = free(docs, "rk")
    k = docs.withColumn(rk, F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    bad = stored(matched(docs, benchmark, rate).select("doc_id", F.col("rk").alias(rk)).distinct(), "leaks")
    return k.join(bad, same_row(k, bad, ("doc_id", rk)), "left_anti").select(docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return matched(docs, items).select("doc_id", "item_id", "edits", "end_char")
