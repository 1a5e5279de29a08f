"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule ``[^\x20\x09-\x0D]+``.
SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share (``spark.checkpoint.dir``).

    Only where the setting is absent, as in local tests, a temporary folder is made and set.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not root:
        root = sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="veldspar-")
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def stored(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back: cuts lineage and survives lost executors.

    The table stays until :func:`dropped`, as results that are not written yet may read it, or, without ``keep``,
    until the :func:`scratch` around it ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/veldspar/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    if _scopes and not keep:
        _scopes[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = path
    weakref.finalize(out, _paths.pop, id(out), None)
    return out


_paths: dict[int, str] = {}
_scopes: list[list[str]] = []


def dropped(*tables: DataFrame | None) -> None:
    """Delete tables of :func:`stored` that nothing reads any more."""
    for df in tables:
        if df is not None and (path := _paths.pop(id(df), None)):
            _delete(df.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are stored inside go at the end, so write or keep the result before."""
    made: list[str] = []
    _scopes.append(made)
    try:
        yield
    finally:
        _scopes.remove(made)
        for path in made:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have, in any case of letters."""
    have = {c.lower() for c in docs.columns}
    while name in have:
        name += "_"
    return name


def keyed(docs: DataFrame) -> DataFrame:
    """Only what operators on texts need: ``doc_id``, ``text`` (null: empty) and ``rk``, a hash of both.

    (doc_id, rk) tells rows with the same id but different texts apart. Rows that are alike in both are
    copies of one another; whatever is decided for one of them holds for the others too.
    """
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("rk", F.xxhash64("doc_id", "text"))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a text column; null counts as empty."""
    column = batch.column(batch.schema.get_field_index(name))
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def slices(batch: pa.RecordBatch, name: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of each part have about ``most`` bytes (one text at least)."""
    import pyarrow.compute as pc

    column = batch.column(batch.schema.get_field_index(name))
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)
