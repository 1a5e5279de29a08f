"""Bit maps of 64-bit names: of a fixed size, whatever they hold, and right about all names that they say are absent.

A bit map of 16 MB is broadcast to keep rows out of shuffles that would find nothing.  It decides nothing: a full
one lets more pass and costs time only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENT = 1 << 19  # bits in each of the 256 parts


def _places(name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = np.uint64(SEGMENT - 1)
    return (name & low).astype(np.int64), (name >> np.uint64(20) & low).astype(np.int64)


def marked(bits: np.ndarray, name: np.ndarray) -> np.ndarray:
    """Whether the bit map holds a name; some that it doesn't hold pass."""
    base, out = (name >> np.uint64(56)).astype(np.int64) * SEGMENT, np.ones(len(name), bool)
    for at in _places(name):
        at = base + at
        out &= (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
    return out


def bit_map(names: DataFrame) -> Broadcast:
    """Broadcast bit map of the column ``name`` (long); its parts are made on the executors, batch by batch."""

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            part, name = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            for p in np.unique(part).tolist():
                bits = held.setdefault(p, np.zeros(SEGMENT, bool))
                for at in _places(name[part == p]):
                    bits[at] = True
        yield pa.RecordBatch.from_pydict({"part": pa.array(list(held), pa.int32()), "bits": pa.array([np.packbits(b, bitorder="little").tobytes() for b in held.values()], pa.binary())})

    parts = names.select(F.shiftrightunsigned("name", 56).cast("int").alias("part"), "name").repartition("part").mapInArrow(run, "part int, bits binary").collect()
    out = np.zeros((256, SEGMENT // 8), np.uint8)
    for r in parts:
        out[r.part] = np.frombuffer(r.bits, np.uint8)
    return names.sparkSession.sparkContext.broadcast(out.reshape(-1))


def passing(rows: DataFrame, column: str, bits: Broadcast) -> DataFrame:
    """Rows whose name the bit map may hold."""

    def run(batches):
        for batch in batches:
            name = batch.column(batch.schema.get_field_index(column)).to_numpy().view(np.uint64)
            yield batch.filter(pa.array(marked(bits.value, name)))

    return rows.mapInArrow(run, rows.schema)
