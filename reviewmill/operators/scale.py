"""Building blocks that keep the operators safe on very large and skewed inputs."""

from __future__ import annotations

import math
import tempfile
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

FAN_IN = 64
#: Of the quantile sketch: its relative rank error is 1 / SKETCH_ACCURACY; marks that are read from it; values of a bracket
#: that come to the driver.
SKETCH_ACCURACY, SKETCH_STEPS, BRACKET_ROWS = 10_000, 1_000, 1_000_000


# --- results kept between jobs ------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach. A local session without one gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="reviewmill-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def path_exists(spark: SparkSession, path: str) -> bool:
    """Asks the file system that the path belongs to; starts no job."""
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()).exists(location)


def delete_path(spark: SparkSession, path: str) -> None:
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    location.getFileSystem(spark._jsc.hadoopConfiguration()).delete(location, True)


def materialize(df: DataFrame) -> DataFrame:
    """Write the frame to the shared folder and read it back: cuts the lineage, survives the loss
    of executors, and gives later jobs a columnar table of known size."""
    spark = df.sparkSession
    application = spark.sparkContext.applicationId  # one folder to drop when it has ended
    path = f"{shared_dir(spark)}/reviewmill/{application}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pin(df: DataFrame) -> DataFrame:
    """Fix a result that is expected to be small: evaluated once, as a written table.

    Spark weighs the table by its file size, so a small one is broadcast and a large one is not;
    nothing passes through the driver.
    """
    return materialize(df)


# --- sums of arrays over all rows -----------------------------------------------------


def arrow_vectors(column: pa.Array) -> np.ndarray:
    """The vectors of an Arrow list column as the rows of a matrix of doubles."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def sum_over(rows: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray | None:
    """Sum of `part(batch)`, arrays of one fixed shape, over all rows; None without rows.

    Every task adds up its own batches. Sums of many tasks are added in FAN_IN tasks first, so the driver gets a bounded
    number of arrays. Partitions are added in their order: the same partitions give the same bits.
    """

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                value = np.asarray(part(batch), dtype=np.float64)
                total = value if total is None else total + value
        if total is not None:
            yield _as_batch(TaskContext.get().partitionId(), total)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [row for batch in batches for row in batch.to_pylist()]
        if found:
            yield _as_batch(min(r["part"] for r in found), _in_order(found))

    schema = "part bigint, shape array<int>, total binary"
    sums = rows.mapInArrow(own, schema)
    if rows.rdd.getNumPartitions() > FAN_IN:
        sums = sums.repartition(FAN_IN, "part").mapInArrow(merged, schema)
    found = [row.asDict() for row in sums.collect()]
    return _in_order(found) if found else None


def _as_batch(part: int, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int64()), pa.array([list(total.shape)], pa.list_(pa.int32())),
         pa.array([total.tobytes()], pa.binary())], names=["part", "shape", "total"])


def _in_order(found: list[dict]) -> np.ndarray:
    total = None
    for row in sorted(found, key=lambda r: r["part"]):
        value = np.frombuffer(row["total"]).reshape(row["shape"])
        total = value if total is None else total + value
    return total


# --- ranking ------------------------------------------------------------------------


def top_n_per_group(
    df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank"
) -> DataFrame:
    """First n rows per group, ranked from 1.

    Each input task keeps its own n best rows per group before anything moves; groups are then
    merged in two levels, so even a group holding most rows never meets in one task unreduced.
    """
    by_slice = Window.partitionBy(*keys, "_slice").orderBy(*order)
    by_group = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_slice", F.pmod(F.spark_partition_id(), F.lit(FAN_IN)))
        .withColumn(rank, F.row_number().over(by_slice))
        .where(F.col(rank) <= n)
        .drop("_slice")
        .withColumn(rank, F.row_number().over(by_group))
        .where(F.col(rank) <= n)
    )


# --- sampling -----------------------------------------------------------------------


def _hash_rank(key: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def uniform_sample(df: DataFrame, size: int, seed: int, key: str = "review_id") -> DataFrame:
    """Exactly min(size, n) rows without replacement, the same ones under any partitioning.

    The sample is the rows with the smallest seeded hash. A hash bound that lets about four times
    the wanted number through is applied first, so that the final sort sees few rows.
    """
    total = df.count()
    hashed = df.withColumn("_hash", _hash_rank(F.col(key), seed))
    if total > 4 * size + 1000:
        bound = "%012x" % int(16**12 * (4 * size + 1000) / total)
        narrowed = hashed.where(F.col("_hash") < bound)
        if narrowed.count() >= size:
            hashed = narrowed
    return hashed.orderBy("_hash", key).limit(size).drop("_hash")


# --- order statistics ---------------------------------------------------------------


def exact_quantile(df: DataFrame, column: str, q: float) -> float | None:
    """Exact linearly interpolated quantile of a numeric column; None when it holds no value. NaN counts as the largest
    value; NULLs do not count.

    A mergeable sketch gives a bracket around the rank in one pass; a second pass counts the values inside it one by one,
    and those below it. Both wanted order statistics lie in the same bracket.
    """
    values = df.select(F.col(column).cast("double").alias("v")).where("v IS NOT NULL")
    near = [q - 4 / SKETCH_STEPS, q + 4 / SKETCH_STEPS]
    found = _order_statistics(values, lambda n: _places(n, q), [m for m in near if 0 <= m <= 1])
    if not found:
        return None
    return found[0] if len(found) == 1 else found[0] + (found[1] - found[0]) * (_position(found.n, q) % 1.0)


def exact_rank_value(df: DataFrame, column: str, rank: int):
    """The value of a numeric column with the given 0-based rank; None past the end."""
    values = df.select(F.col(column).alias("v")).where("v IS NOT NULL")
    found = _order_statistics(values, lambda n: [rank] if rank < n else [])
    return found[0] if found else None


class _Found(list):
    """Order statistics, with the number of values they come from."""

    n = 0


def _position(n: int, q: float) -> float:
    return (n - 1) * q


def _places(n: int, q: float) -> list[int]:
    if not n:
        return []
    below = math.floor(_position(n, q))
    return [below] if _position(n, q) == below else [below, below + 1]


def _order_statistics(values: DataFrame, wanted: Callable[[int], list[int]], near: list[float] | None = None) -> _Found:
    """The values of column v, none of them NULL, at the 0-based ranks that `wanted` names for their number. near: shares of
    the rows around these ranks, where they are known before.

    The sketch's ranks are off by at most 1 / SKETCH_ACCURACY of the rows it has seen. A bracket that may hold more than
    BRACKET_ROWS values is narrowed by another sketch of the values inside, so that the driver gets a bounded number of them:
    two passes for a hundred million rows, three for some 10^11.
    """
    real = ~F.isnan(F.col("v").cast("double"))
    even = [i / SKETCH_STEPS for i in range(SKETCH_STEPS + 1)]
    grid = even if near is None else near
    low = high = None
    found = _Found()
    while True:
        above = F.lit(True) if low is None else F.col("v") >= F.lit(low)
        inside = (above if high is None else above & (F.col("v") <= F.lit(high))) & real
        seen = _pass_over(values.agg(
            F.count(F.lit(1)).alias("n"), F.count_if(real).alias("real"),
            (F.lit(0) if low is None else F.count_if(real & ~above)).alias("below"), F.count_if(inside).alias("inside"),
            F.percentile_approx(F.when(inside, F.col("v")), grid or [0.5], SKETCH_ACCURACY).alias("marks"),
        ))[0]
        found.n = seen["n"]
        ranks = wanted(seen["n"])
        places = [r for r in ranks if r < seen["real"]]
        if not places:
            found += [float("nan")] * len(ranks)
            return found
        # marks whose true ranks surely lie on either side of all wanted ones
        off = 2 / SKETCH_ACCURACY + 2 / max(seen["inside"], 1)
        first = (places[0] - seen["below"]) / max(seen["inside"], 1) - off
        last = (places[-1] - seen["below"] + 1) / max(seen["inside"], 1) + off
        below, beyond = bisect_right(grid, first) - 1, bisect_left(grid, last)
        before = (low, high)
        share = (grid[beyond] if beyond < len(grid) else 1.0) - (grid[below] if below >= 0 else 0.0)
        low = _widened(seen["marks"][below], -1) if below >= 0 else low
        high = _widened(seen["marks"][beyond], 1) if beyond < len(grid) else high
        few = (share + off) * seen["inside"] <= BRACKET_ROWS
        grid = even
        if few or (low is not None and low == high) or before == (low, high):  # ties: no sketch can part equal values
            break
    under = F.lit(False) if low is None else F.col("v") < F.lit(low)
    kept = values.where(real if high is None else real & (F.col("v") <= F.lit(high)))
    # all values below the bracket are one group; inside it, equal values are one
    groups = _pass_over(kept.groupBy(F.when(~under, F.col("v")).alias("v")).agg(F.count(F.lit(1)).alias("n")))
    counts = {row["v"]: row["n"] for row in groups}
    passed = counts.pop(None, 0)
    for value in sorted(counts):
        passed += counts[value]
        while places and places[0] < passed:
            found.append(value)
            places.pop(0)
    found += [float("nan")] * (len(ranks) - len(found))
    return found


def _pass_over(frame: DataFrame) -> list:
    """One pass over the values."""
    return frame.collect()


def _widened(mark, side: int):
    """A whole mark is moved outwards by what the sketch, which computes in doubles, may have rounded."""
    if isinstance(mark, int) and abs(mark) >= 2**52:
        return max(-(2**63), min(2**63 - 1, mark + side * (abs(mark) >> 48)))
    return mark
