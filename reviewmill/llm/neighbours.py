"""Nearest neighbours by block products of int8 codes with error bounds, and exact distances for what remains."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewmill.llm.scratch import located, stored

QUERY_ROWS = 512
BLOCK_ROWS = 2048
#: Bytes of vectors that meet all queries at once, and of those that are scored at once.
HELD_BYTES, SCORED_BYTES = 1 << 25, 1 << 24
#: Products of codes are summed in float32, exactly, over this many components at a time.
EXACT_COMPONENTS = 1024
LEVELS = 127
#: Rounding of norms and products, relative to the lengths of both vectors.
SLACK = 1e-7
#: Scales of a tile must lie within this factor of a common one for its bounds to be taken in single precision.
SPREAD = 2.0**30
_BLOCK = "width int, block long, ids binary, vectors binary, codes binary, scales binary, errors binary"


def blocks_of(vectors: DataFrame, key: str, vector: str, rows: int) -> DataFrame:
    """Matrix blocks of up to `rows` vectors of one width, as they lie in the partitions.

    A vector is stored in double precision and as int8 codes with a scale; its error is the distance between both.
    Rows with a null key, and vectors that are null, empty, zero or hold null or non-finite components are left out.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, (width, ids, matrix) in enumerate(_usable(batches, rows)):
            yield _packed(width, number, ids, matrix)

    return vectors.select(F.col(key).cast("long"), F.col(vector)).mapInArrow(pack, _BLOCK)


def _usable(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, keys, vectors) of up to `rows` rows of one width each, without unusable rows."""
    for batch in batches:
        lists = batch.column(1)
        lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat = lists.flatten().cast(pa.float64())
        ends = np.cumsum(lengths)
        values = flat.fill_null(np.nan).to_numpy(zero_copy_only=False)
        named = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
        ids = batch.column(0).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
        for width in np.unique(lengths[lengths > 0]).tolist():
            rows_of = np.flatnonzero((lengths == width) & named)
            matrix = values[(ends[rows_of] - width)[:, None] + np.arange(width)]
            good = np.isfinite(matrix).all(1) & matrix.any(1)
            matrix, own = matrix[good], ids[rows_of[good]]
            for at in range(0, len(own), rows):
                yield width, own[at: at + rows], matrix[at: at + rows]


def _coded(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of vectors, their scales, and the distances between vectors and codes."""
    scales = np.abs(matrix).max(1) / LEVELS
    scales[scales == 0] = 1.0  # components too small to be divided: the codes are zero and the error is the length
    codes = np.rint(matrix / scales[:, None]).astype(np.int8)
    return codes, scales, np.sqrt(((matrix - codes * scales[:, None]) ** 2).sum(1))


def _packed(width: int, number: int, ids: np.ndarray, matrix: np.ndarray) -> pa.RecordBatch:
    parts = [np.ascontiguousarray(a).tobytes() for a in (ids, matrix, *_coded(matrix))]
    return pa.RecordBatch.from_arrays(
        [pa.array([width], pa.int32()), pa.array([number], pa.int64()), *[pa.array([p], pa.binary()) for p in parts]],
        ["width", "block", "ids", "vectors", "codes", "scales", "errors"],
    )


def nearest(vectors: DataFrame, queries: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding",
            query_rows: int = QUERY_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of each row that `queries` selects, by Euclidean distance.

    Queries are written once, in blocks; tasks hold some vectors at a time and stream through the queries' files, so neither
    side is copied or sent to the driver. A product of two blocks of codes bounds all distances of a tile. Pairs whose lower
    bound passes the k-th distance that the task has found for their query are out; the others are computed in double
    precision, component by component in order, and merged with the query's best. The best of the tasks are merged by rank.
    Nothing within the bounds is lost: results are exact. A task holds k keys and distances of every query.

    Ties go to the smaller key. A row is no neighbour of rows with its own key. Rows that repeat a key are candidates each,
    and one query, that of the smallest vector. Only vectors of equal width are compared. A query with fewer than k candidates returns all; unusable vectors
    (see blocks_of) take no part on either side; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    asked = vectors.where(queries).groupBy(key).agg(F.min(vector).alias(vector))
    few = max(1, -(-vectors.where(queries).count() // query_rows))
    left = stored(blocks_of(asked.repartition(few, key), key, vector, query_rows), "queries")
    among = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector")).where("id is not null")
    # tasks of equal size: the work of a row is that of all queries
    found = among.repartition(spark.sparkContext.defaultParallelism).mapInArrow(
        _Nearest(left.inputFiles(), k, query_rows, block_rows), "query_id long, vec_id long, score double"
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def plus_square(total: np.ndarray, x: np.ndarray) -> np.ndarray:
    """total + x * x rounded once, as a fused multiply-add does: both rounding errors are found and added back."""
    with np.errstate(over="ignore", invalid="ignore"):
        square = x * x
        split = 134217729.0 * x
        high = split - (split - x)
        low = x - high
        lost = (high * high - square) + 2 * high * low + low * low
        added = total + square
        back = added - total
        lost = lost + ((total - (added - back)) + (square - back))
    return added + np.where(np.isfinite(lost), lost, 0.0)


class _Nearest:
    """The best rows of a task for every query."""

    def __init__(self, files: list[str], k: int, query_rows: int, block_rows: int):
        self.files, self.query_rows, self.block_rows, self.tile = files, query_rows, block_rows, _Tile(k)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, _Best] = {}
        held, rows, size, seen = defaultdict(list), 0, 0, 0
        for width, ids, matrix in _usable(batches, self.block_rows):
            held[width].append((ids, matrix))
            rows, size = rows + len(ids), size + matrix.nbytes
            if rows >= max(self.block_rows, seen) or size >= HELD_BYTES:  # few rows first: they give the first distances
                self._meet(held, best)
                held, rows, size, seen = defaultdict(list), 0, 0, seen + rows
        self._meet(held, best)
        while best:
            yield best.popitem()[1].rows()

    def _meet(self, held: dict[int, list], best: dict[int, _Best]) -> None:
        """All queries and the vectors held."""
        blocks = {}
        for width, parts in held.items():
            ids, matrix = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            codes, scales, errors = _coded(matrix)
            common = float(np.median(scales))
            blocks[width] = common, [
                _Right((ids[own], matrix[own], codes[own].astype(np.float32), scales[own], errors[own]), common)
                for own in (slice(at, at + self.block_rows) for at in range(0, len(ids), self.block_rows))
            ]
        held.clear()
        if not blocks:
            return
        for number, (width, asked) in enumerate(self._queries()):
            if width in blocks:
                if number not in best:
                    best[number] = _Best(asked[0], self.tile.k)
                self._block(asked, *blocks[width], best[number])

    def _queries(self) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
        """(width, block) of all queries, small blocks joined, always in the same order."""
        some, rows = defaultdict(list), defaultdict(int)
        for uri in self.files:
            store, path = located(uri)
            with store.open_input_file(path) as file:
                for batch in pq.ParquetFile(file).iter_batches(1):
                    for row in batch.to_pylist():
                        width = row["width"]
                        some[width].append(self.tile._side(row, ""))
                        rows[width] += len(some[width][-1][0])
                        if rows[width] >= self.query_rows:
                            yield width, tuple(map(np.concatenate, zip(*some.pop(width), strict=True)))
                            del rows[width]
        for width in sorted(some):
            yield width, tuple(map(np.concatenate, zip(*some[width], strict=True)))

    def _block(self, asked: tuple, common: float, blocks: list[_Right], best: _Best) -> None:
        pairs, count, left = [], 0, None
        most = max(1, SCORED_BYTES // asked[1][0].nbytes)
        for block in blocks:
            if left is None:
                left = self.tile._left(asked, best.limit, common)
            fast = left is not None and block.matrix is not None
            if fast:
                query, other = self.tile._reached(asked, left, block)
            else:
                query, other = self.tile._survivors(asked, block.side, best.limit)
            for at in range(0, len(query), most):
                pairs.append((query[at: at + most], block.side, other[at: at + most]))
                count += len(pairs[-1][0])
                if count >= most or left is None:
                    best.add(*self._scored(asked, pairs))
                    pairs, count, left = [], 0, None
        if pairs:
            best.add(*self._scored(asked, pairs))

    @staticmethod
    def _scored(asked: tuple, pairs: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        query = np.concatenate([q for q, _, _ in pairs])
        ids = np.concatenate([side[0][v] for _, side, v in pairs])
        vectors = np.concatenate([side[1][v] for _, side, v in pairs])
        score = np.zeros(len(query))
        for x, y in zip(asked[1].T, vectors.T, strict=True):
            score = plus_square(score, x[query] - y)
        return query, ids, np.sqrt(score)


class _Best:
    """The k nearest of each of some queries so far; `limit` has the k-th distance, infinite while there are fewer."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k, self.limit = queries, k, np.full(len(queries), np.inf)
        self.query, self.ids, self.scores = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)

    def add(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        query, ids, scores = (np.concatenate(p) for p in ((self.query, query), (self.ids, ids), (self.scores, scores)))
        order = np.lexsort((ids, scores, query))
        query = query[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        kept = order[rank < self.k]
        self.query, self.ids, self.scores = query[rank < self.k], ids[kept], scores[kept]
        last = rank == self.k - 1
        self.limit[query[last]] = scores[order[last]]

    def rows(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(self.queries[self.query]), pa.array(self.ids), pa.array(self.scores)], ["query_id", "vec_id", "score"]
        )


class _Right:
    """A block of vectors, and its side of the product that _Tile._reached takes; None where scales are too far apart."""

    def __init__(self, side: tuple[np.ndarray, ...], common: float):
        _, _, codes, scales, errors = self.side = side
        self.matrix = None
        if SPREAD > common / scales.min() and scales.max() / common < SPREAD:
            norm = np.sqrt((codes.astype(float) ** 2).sum(1))
            error = errors / scales + SLACK * norm
            rest = (norm**2 - error**2) * (scales / common)
            self.matrix = np.vstack([
                codes.T, common / scales, -rest + _rounding(codes) * np.abs(rest), error, norm,
            ]).astype(np.float32)


def _rounding(codes: np.ndarray) -> float:
    """What a product in single precision may be off by, relative to the sum of its terms' sizes."""
    return (codes.shape[1] + 8) * 2.0**-23


class _Tile:
    def __init__(self, k: int):
        self.k = k

    @staticmethod
    def _side(row: dict, prefix: str) -> tuple[np.ndarray, ...]:
        kinds = {"ids": np.int64, "vectors": np.float64, "codes": np.int8, "scales": np.float64, "errors": np.float64}
        ids, matrix, codes, scales, errors = (np.frombuffer(row[prefix + n], kind) for n, kind in kinds.items())
        return ids, matrix.reshape(len(ids), -1), codes.reshape(len(ids), -1).astype(np.float32), scales, errors

    @staticmethod
    def _left(asked: tuple, limit: np.ndarray, common: float) -> np.ndarray | None:
        """The queries' side of the product in _reached; None where a query has no limit yet or scales are too far apart."""
        _, _, codes, scales, errors = asked
        norm = np.sqrt((codes.astype(float) ** 2).sum(1))
        with np.errstate(over="ignore", invalid="ignore"):
            reach = (limit + errors) / scales + SLACK * norm
            near = (common / scales.min() < SPREAD) and (scales.max() / common < SPREAD) and reach.max() < SPREAD
        if not near:
            return None
        slack = _rounding(codes)
        rest = (norm**2 - reach**2) / 2 * (scales / common)
        return np.column_stack([
            codes, -rest + slack * np.abs(rest), common / scales / 2, (1 + slack) * reach, slack * norm,
        ]).astype(np.float32)

    @staticmethod
    def _reached(asked: tuple, left: np.ndarray, block: _Right) -> tuple[np.ndarray, np.ndarray]:
        """Pairs whose distance may be within the limit of the query.

        With lengths q and v and scales s and t of the codes, errors e of both sides, P the product of codes and L the limit,
        q^2 + v^2 - 2 P s t <= (L + e_q + e_v)^2. Divided by 2 s t and ordered, all of it is one product of matrices, with a
        column more for what its rounding in single precision may hide.
        """
        tile = left @ block.matrix
        rows = np.flatnonzero(tile.max(1) >= 0)
        query, other = np.nonzero(tile[rows] >= 0)
        query = rows[query]
        others = asked[0][query] != block.side[0][other]
        return query[others], other[others]

    def _survivors(self, asked: tuple, among: tuple, limit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        product = np.zeros((len(asked[0]), len(among[0])))
        for at in range(0, asked[2].shape[1], EXACT_COMPONENTS):
            part = slice(at, at + EXACT_COMPONENTS)
            product += asked[2][:, part] @ among[2][:, part].T
        length_q, length_v = (s * np.sqrt((c.astype(float) ** 2).sum(1)) for _, _, c, s, _ in (asked, among))
        square = length_q[:, None] ** 2 + length_v ** 2 - 2 * product * asked[3][:, None] * among[3]
        about = np.sqrt(np.maximum(square, 0))
        error = asked[4][:, None] + among[4] + SLACK * (length_q[:, None] + length_v)
        own = asked[0][:, None] == among[0]
        upper = np.where(own, np.inf, about + error)
        k = min(self.k, upper.shape[1])
        kth = np.partition(upper, k - 1, axis=1)[:, k - 1: k]
        if limit is not None:
            kth = np.minimum(kth, limit[:, None])
        return np.nonzero(~(about - error > kth) & ~own)
