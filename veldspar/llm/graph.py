"""De Bruijn graph of repeated k-mers, compacted by joins.

What repeats comes as units: k-mers that share a minimizer and stand together wherever they do, or in several places,
travel as one (a super-k-mer), others alone.  Units are nodes; where one unit's last k-mer and another's first are neighbours in a document, they
are joined by an edge.  A node's degrees count its edges, ends of documents and of repeats among them.  A link
between two nodes doesn't branch if it is the only edge out of the one and the only one into the other; nodes
joined by such links make a path, found by pointer doubling.  Wherever the first node of a path stands, all of the
path follows, so a path's occurrences are those of its first node.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored

ROUNDS = 48  # of doubling: paths of up to 2**48 nodes; only names that collide could make a ring


def edges(lists: DataFrame) -> DataFrame:
    """(u, v, n, c): how often unit u, of n windows, is followed at once by unit v, or (v null) by none."""

    def run(batches):
        for batch in batches:
            column = batch.column(0).combine_chunks() if isinstance(batch.column(0), pa.ChunkedArray) else batch.column(0)
            s, n, u = (np.asarray(c) for c in column.flatten().flatten())
            row = np.repeat(np.arange(len(column)), column.value_lengths().to_numpy())
            order = np.lexsort((s, row))
            s, n, u, row = s[order], n[order], u[order], row[order]
            ends = np.append((row[1:] != row[:-1]) | (s[1:] != s[:-1] + n[:-1]), True) if len(s) else np.zeros(0, bool)
            v = np.where(ends, 0, np.append(u[1:], 0))
            both = np.stack([u, v, ends, n], axis=1).astype(np.int64)
            both, c = np.unique(both, axis=0, return_counts=True)
            yield pa.RecordBatch.from_pydict({"u": pa.array(both[:, 0]), "v": pa.array(both[:, 1], mask=both[:, 2] != 0), "n": pa.array(both[:, 3]), "c": pa.array(c.astype(np.int64))})

    found = lists.select("units").mapInArrow(run, "u long, v long, n long, c long")
    return found.groupBy("u", "v").agg(F.max("n").alias("n"), F.sum("c").alias("c"))


def links(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes u, n; links u, v that don't branch)."""
    nodes = found.groupBy("u").agg(F.max("n").alias("n"), F.sum("c").alias("c"), F.count("*").alias("outgoing"))
    into = found.where("v is not null").groupBy(F.col("v").alias("u")).agg(F.sum("c").alias("entered"), F.count("*").alias("incoming"))
    nodes = stored(nodes.join(into, "u", "left"), "nodes")
    straight = found.where("v is not null").join(nodes.where("outgoing = 1").select("u"), "u")
    whole = nodes.where("incoming = 1 and entered = c").select(F.col("u").alias("v"))
    return nodes.select("u", "n"), straight.join(whole, "v").select("u", "v", "n")


def paths(found: DataFrame) -> DataFrame:
    """(u, windows): first unit of each path and the number of windows in the path."""
    nodes, straight = links(found)
    before = straight.select(F.col("v").alias("u"), F.col("u").alias("at"), F.col("n").alias("d"))
    start = nodes.join(before, "u", "left")
    # at: an earlier node of the path, d windows before; a path's first node stands for itself.
    now = stored(start.select("u", "n", F.coalesce("at", "u").alias("at"), F.coalesce("d", F.lit(0)).alias("d"), F.col("at").isNull().alias("over")), "pointers")
    over = now.where("over")
    held = [nodes, now]
    for _ in range(ROUNDS):
        open_ = now.where("not over")
        if not open_.limit(1).count():
            break
        every = over.union(open_).select(F.col("u").alias("at"), F.col("at").alias("at2"), F.col("d").alias("d2"), F.col("over").alias("over2"))
        now = stored(open_.join(every, "at").select("u", "n", F.col("at2").alias("at"), (F.col("d") + F.col("d2")).alias("d"), F.col("over2").alias("over")), "pointers")
        held.append(now)
        over = over.union(now.where("over"))
    out = stored(over.groupBy(F.col("at").alias("u")).agg(F.max(F.col("d") + F.col("n")).alias("windows")), "paths")
    dropped(*held)
    return out


def compacted(lists: DataFrame, width: int, keys: tuple[str, ...]) -> DataFrame:
    """Occurrences of paths by document: keys, ``spans`` of path, s, e (in words); ``lists`` is from :func:`repeats.find`."""
    found = stored(edges(lists), "edges")
    whole = paths(found)
    dropped(found)
    heads = lists.select(*keys, F.explode("units").alias("unit")).select(*keys, "unit.s", "unit.u").join(whole, "u")
    span = F.struct(F.col("u").alias("path"), F.col("s").cast("long").alias("s"), (F.col("s") + F.col("windows") + width - 1).alias("e"))
    return heads.groupBy(*keys).agg(F.collect_list(span).alias("spans"))
