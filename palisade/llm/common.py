"""What the operators of this folder share: the shared work folder, feature hashing, components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_WORK_DIR: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share. It is deleted when the application ends.

    Only a local master may go without that setting (tests); it then gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN_WORK_DIR:
            _OWN_WORK_DIR[app] = "file://" + tempfile.mkdtemp("palisade")
        base = _OWN_WORK_DIR[app]
    folder = f"{base.rstrip('/')}/palisade-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(path)  # only what is there can be marked for deletion
    store.deleteOnExit(path)
    return folder


def discard(df: DataFrame) -> None:
    """Delete the files of a stored() table that nothing will read any more; the others go when the application ends."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: the lineage ends here, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_key() -> Column:
    """A document row's key: 128 bits of hashes of its id and text. Rows alike in both share it and are treated alike."""
    half = lambda *salt: F.lpad(F.hex(F.xxhash64(*salt, "doc_id", "text")), 16, "0")
    return F.unhex(F.concat(half(), half(F.lit(1))))


def with_lookup(rows: DataFrame, key: Column, found: DataFrame, new: dict[str, Column]) -> DataFrame:
    """rows with the columns new, which may use row__ (the row as a struct) and the columns of found, joined on its key__.

    The row travels as one struct, so its own columns, whatever their names, clash with nothing; a column that is also in
    new is replaced.
    """
    out = rows.select(F.struct("*").alias("row__"), key.alias("key__")).join(found, "key__", "left")
    # the new columns get their own names only after they are computed: an output name must not stand for a column of found
    out = out.select("row__", F.struct(*[x.alias(c) for c, x in new.items()]).alias("new__"))
    return out.select(*[F.col(f"row__.`{c}`") for c in rows.columns if c not in new], *[F.col(f"new__.`{c}`") for c in new])


#: Lists of keys (16 bytes each) up to this length are broadcast; a longer one is joined by shuffle.
BROADCAST_KEYS = 250_000


def without(rows: DataFrame, key: Column, gone: DataFrame) -> DataFrame:
    """rows whose key isn't among those of gone (a stored table of one column key__)."""
    if gone.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        gone = F.broadcast(gone)
    out = rows.select(F.struct("*").alias("row__"), key.alias("key__")).join(gone, "key__", "left_anti")
    return out.select(*[F.col(f"row__.`{c}`") for c in rows.columns])


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (xor-shift-multiply), vectorised."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def gram_counts(data: bytes, log2_dims: int, sizes: tuple[int, ...]) -> np.ndarray:
    """Counts of the hashed byte n-grams of the given sizes, in 2 ** log2_dims buckets."""
    out = np.zeros(1 << log2_dims, dtype=np.float32)
    b = np.frombuffer(data, dtype=np.uint8).astype(np.uint32)
    shift = np.uint32(32 - log2_dims)
    for n in sizes:
        if len(b) < n:
            continue
        h = np.full(len(b) - n + 1, n, dtype=np.uint32)
        for i in range(n):
            h = h * np.uint32(257) + b[i : len(b) - n + 1 + i]
        out += np.bincount((h * np.uint32(2654435761)) >> shift, minlength=1 << log2_dims)
    return out


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class Forest:
    """Union by smaller key with path halving, for the edges inside one bounded group."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of each connected component, by alternating large-star and small-star steps.

    Each step is a grouped minimum with map-side combination and a join, so a hub is never gathered into one task.
    Every round is written to the shared folder; it ends when all components are stars.
    """
    e = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct(), "edges")
    for _ in range(rounds):
        # done when every node with a smaller one has just that one, and that one has none
        ends = e.select(F.col("u").alias("n"), F.lit(1).alias("ups"), F.lit(0).alias("root")).unionByName(e.select(F.col("v").alias("n"), F.lit(0).alias("ups"), F.lit(1).alias("root")))
        if ends.groupBy("n").agg(F.sum("ups").alias("ups"), F.max("root").alias("root")).filter("ups > 1 OR (ups = 1 AND root = 1)").isEmpty():
            break
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # a table of minima, so that a hub's edges can be split over tasks when they are joined
        low = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        before, e = e, stored(small.filter("u != v").distinct(), "edges")
        discard(before)
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
