"""Nearest neighbours by randomly rotated one-bit codes.

Vectors are dealt to lists by their nearest centroid. A vector's residual is rotated by a
random orthogonal matrix and keeps one bit for each dimension, its norm, and its inner
product with its own code; from these the inner product with any query is estimated, with a
bound on the error. First only codes meet the queries: those of a query's nearest list, then
those of its other lists, which must come below the k-th smallest upper bound so far. Blocks
of a list that hold a vector whose lower bound does not exceed it are then read with their
original vectors, and the vectors that the bounds leave are compared by their components.

Centroids, and how many lists a query looks into, are fitted on a sample. There are about half
the square root of the rows lists, and eight vectors of the sample for each; ``fit_bytes`` bounds
the sample, and a fourth of it the lists. Every row is indexed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memberlens.llm.scratch import Scratch, saved


@dataclass(frozen=True)
class Index:
    #: Vectors, about, that centroids and the number of probed lists are fitted on, at least.
    sample: int = 8192
    #: Bytes of the sample on the driver, at most.
    fit_bytes: int = 128 << 20
    #: Share of the sample's true neighbours that lie in the probed lists.
    recall: float = 0.985
    #: Queries, and codes, that meet in one task, at most.
    block: int = 4096
    codes: int = 1 << 14
    #: Error bounds hold in all but a few of a thousand cases.
    deviations: float = 3.0
    seed: int = 7


#: Numbers in a matrix of distances or bounds that is held at a time.
HELD = 1 << 20
#: With so many lists, at most, every vector is compared with every centroid.
ONE_CELL = 1024


def usable(vector: Column, dimension: int) -> Column:
    """Not null, of the dimension, all components finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(
        (F.size(vector) == dimension) & finite & F.exists(vector, lambda x: x != 0), F.lit(False)
    )


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, dimension).astype(np.float64)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T, 0)


def _slices(rows: int, width: int) -> Iterator[slice]:
    step = max(1, HELD // max(1, width))
    return (slice(lo, lo + step) for lo in range(0, rows, step))


def _closest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    found = [_squares(rows[s], centres).argmin(1) for s in _slices(len(rows), len(centres))]
    return np.concatenate(found) if found else np.empty(0, np.int64)


def _centroids(sample: np.ndarray, n: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), n, replace=False)]
    for _ in range(10):
        nearest = _closest(sample, centres)
        counts = np.bincount(nearest, minlength=n)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


@dataclass(frozen=True)
class Lists:
    """Centroids in the order of their cells; a vector's list is the nearest of its nearest cell."""

    cells: np.ndarray
    centres: np.ndarray
    #: Where each cell's centroids begin, and the end.
    begin: np.ndarray

    @classmethod
    def fitted(cls, sample: np.ndarray, n: int, seed: int) -> Lists:
        """``n`` centroids, beyond ``ONE_CELL`` in sqrt(n) cells, in each as its share of the sample."""
        if n <= ONE_CELL:
            return cls(sample.mean(0)[None], _centroids(sample, n, seed), np.array([0, n]))
        cells = _centroids(sample, round(np.sqrt(n)), seed)
        cell = _closest(sample, cells)
        cells, cell = cells[np.unique(cell)], np.unique(cell, return_inverse=True)[1]
        inside = [sample[cell == c] for c in range(len(cells))]
        share = [max(1, min(len(x), n * len(x) // len(sample))) for x in inside]
        centres = [_centroids(x, k, seed) for x, k in zip(inside, share, strict=True)]
        return cls(cells, np.concatenate(centres), np.concatenate([[0], np.cumsum(share)]))

    def of(self, rows: np.ndarray) -> np.ndarray:
        cell = _closest(rows, self.cells)
        found = np.empty(len(rows), np.int64)
        for c in np.unique(cell):
            at = np.flatnonzero(cell == c)
            lo, hi = self.begin[c], self.begin[c + 1]
            found[at] = lo + _closest(rows[at], self.centres[lo:hi])
        return found

    def nearest(self, rows: np.ndarray, n: int) -> np.ndarray:
        """Each row's ``n`` lists with the nearest centroids, nearest first."""
        found = np.empty((len(rows), n), np.int32)
        for s in _slices(len(rows), len(self.centres)):
            found[s] = _squares(rows[s], self.centres).argsort(1, kind="stable")[:, :n]
        return found


def _probes(sample: np.ndarray, lists: Lists, k: int, recall: float) -> int:
    """The lists a query must look into so that the sample's own neighbours are found.

    The first of the sample ask; it must be in a random order.
    """
    queries, list_of = sample[:256], lists.of(sample)
    k = min(k, len(sample) - 1)
    ranks = []
    for s in _slices(len(queries), len(sample)):
        distance = _squares(queries[s], sample)
        distance[np.arange(len(distance)), np.arange(len(queries))[s]] = np.inf
        near = np.argpartition(distance, max(k - 1, 0), 1)[:, :k]
        place = _squares(queries[s], lists.centres).argsort(1).argsort(1)
        ranks.append(np.take_along_axis(place, list_of[near], 1).ravel())
    ranks = np.sort(np.concatenate(ranks))
    return int(ranks[min(len(ranks) - 1, int(recall * len(ranks)))]) + 1 if len(ranks) else 1


def _rotation(dimension: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dimension, dimension)))
    return q * np.sign(np.diag(r))


def encode(residuals: np.ndarray, rotation: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed bits, norms, and inner products of the unit residuals with their codes."""
    norms = np.sqrt((residuals**2).sum(1))
    units = residuals @ rotation / np.where(norms > 0, norms, 1)[:, None]
    fit = np.abs(units).sum(1) / np.sqrt(units.shape[1])
    return np.packbits(units > 0, axis=1), norms, np.where(fit > 0, fit, 1)


def estimate(
    codes: np.ndarray, fit: np.ndarray, queries: np.ndarray, deviations: float
) -> tuple[np.ndarray, np.ndarray]:
    """Inner products of unit residuals (rows) with rotated unit queries, and error bounds.

    For each byte of a code, the sums of a query's components under all 256 patterns are
    looked up.
    """
    dimension = queries.shape[1]
    patterns = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64)
    padded = np.zeros((len(queries), codes.shape[1] * 8))
    padded[:, :dimension] = queries
    ones = np.zeros((len(codes), len(queries)))
    for byte in range(codes.shape[1]):
        ones += (patterns @ padded[:, 8 * byte : 8 * byte + 8].T)[codes[:, byte]]
    signs = (2 * ones - queries.sum(1)[None]) / np.sqrt(dimension)
    error = np.sqrt(np.maximum(1 - fit**2, 0)) / fit / np.sqrt(max(dimension - 1, 1)) * deviations
    return signs / fit[:, None], error


def nearest(
    vectors: DataFrame,
    is_query: Column,
    *,
    k: int = 10,
    id: str = "vec_id",
    vector: str = "embedding",
    index: Index = Index(),
) -> DataFrame:
    """query_id, rank, vec_id and score: each query's ``k`` nearest by Euclidean distance.

    Rows of the query's own id are no candidates. Rows without an id, and vectors that are
    null, zero, not finite or not of the commonest dimension, take no part.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    sizes = vectors.filter(F.size(vector) > 0).groupBy(F.size(vector).alias("d")).count()
    common = sizes.orderBy(F.desc("count"), "d").first()
    if common is None:
        return empty
    dimension, wanted = common["d"], np.sqrt(common["count"]) / 2
    rows = vectors.filter(F.col(id).isNotNull() & usable(F.col(vector), dimension)).select(
        F.col(id).cast("bigint").alias("id"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
        F.col(vector).alias("v"),
    )
    sample = _sample(rows, dimension, min(max(index.sample, 8 * wanted), index.fit_bytes / 8 / dimension))
    if not len(sample):
        return empty
    n_lists = int(min(max(1, wanted), max(1, len(sample) // 4)))
    lists = Lists.fitted(sample, n_lists, index.seed)
    probes = _probes(sample, lists, k, index.recall)
    shared = spark.sparkContext.broadcast((lists, _rotation(dimension, index.seed)))
    scratch = Scratch(spark)
    try:
        stored = _stored(scratch, rows, shared, dimension)
        codes = _without_repeats(scratch, stored, k)
        held = _in_lists(codes, len(lists.centres))
        # However a query lies, the lists it looks into hold k other rows, if there are as many.
        probes = max(probes, int(np.searchsorted(np.cumsum(np.sort(held)), k + 1)) + 1)
        asked = _asked(scratch, stored, shared, dimension, min(probes, len(held)))
        meet = _Meeting(shared, held, dimension, k, index)

        def least(of: DataFrame) -> DataFrame:
            return of.groupBy("query").agg(F.min("reach").alias("least"))

        nowhere = F.lit(float("inf"))
        first = scratch.saved(meet.bounds(codes, asked.filter("place = 0").withColumn("least", nowhere)))
        further = asked.filter("place > 0").join(least(first), "query", "left")
        further = meet.bounds(codes, further.withColumn("least", F.coalesce("least", nowhere)))
        bounded = scratch.saved(first.unionByName(further))
        open_ = bounded.join(least(bounded), "query").filter("low <= least")
        open_ = open_.select("query", "list", "at", "least")
        whole = stored.drop("asks", "same")
        if held.sum() < stored.count():
            whole = codes.join(stored.select("row", "v"), "row")
        asking = scratch.saved(asked.join(open_, ["query", "list"]).drop("place"))
        return saved(meet.ranked(whole, asking))
    finally:
        scratch.remove()


def _sample(rows: DataFrame, dimension: int, size: float) -> np.ndarray:
    """About ``size`` of the vectors, in a random order; at least one, if there is one."""
    hashed = F.xxhash64("id", "v")
    draw = F.pmod(hashed, F.lit(1 << 30)) / float(1 << 30)
    # Rows that repeat share a draw: they count once, and come once.
    unlike = rows.agg(F.approx_count_distinct(hashed)).first()[0]
    chosen = rows.filter(draw < size / max(1, unlike)).select("id", "v").distinct()
    # In the order of the hash, so that the first are a random part, whatever ids follow.
    table = chosen.orderBy(hashed, "id").toArrow()
    if not table.num_rows:
        table = rows.select("id", "v").limit(1).toArrow()
    if not table.num_rows:
        return np.empty((0, dimension))
    return _matrix(table["v"].combine_chunks(), dimension)


def _stored(scratch: Scratch, rows: DataFrame, shared: Broadcast, dimension: int) -> DataFrame:
    """row (a number), id, asks, v, same (a hash of v), list, code, norm and fit of each row."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, rotation = shared.value
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch.column("v"), dimension)
                of = lists.of(v)
                codes, norms, fit = encode(v - lists.centres[of], rotation)
                bits = pa.array([c.tobytes() for c in codes], pa.binary())
                more = [pa.array(of, pa.int32()), bits, pa.array(norms), pa.array(fit)]
                names = [*batch.schema.names, "list", "code", "norm", "fit"]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=names)

    of_v = rows.schema["v"].dataType.simpleString()
    coded = rows.withColumn("same", F.xxhash64("v")).mapInArrow(
        deal,
        f"id bigint, asks boolean, v {of_v}, same bigint, list int, code binary, norm double, fit double",
    )
    return scratch.saved(coded.withColumn("row", F.monotonically_increasing_id()))


def _without_repeats(scratch: Scratch, stored: DataFrame, k: int) -> DataFrame:
    """The codes, of equal vectors only those that can be among a query's ``k`` nearest.

    Equal vectors are equally far from a query, so smaller ids come first: beside the query's
    own, the ``k`` smallest, and of each no more than ``k`` rows.
    """
    equal = ["list", "same", "code", "norm", "fit"]
    of_id = F.row_number().over(Window.partitionBy(*equal, "id").orderBy("row"))
    of_vector = F.dense_rank().over(Window.partitionBy(*equal).orderBy("id"))
    codes = stored.select("row", "id", *equal)
    codes = codes.withColumn("n", of_id).filter(F.col("n") <= k)
    codes = codes.withColumn("n", of_vector).filter(F.col("n") <= k + 1)
    return scratch.saved(codes.select("row", "id", "list", "code", "norm", "fit"))


def _in_lists(rows: DataFrame, n_lists: int) -> np.ndarray:
    """Rows in each list; a number for each comes to the driver."""
    held = np.zeros(n_lists, np.int64)
    for r in rows.groupBy("list").count().collect():
        held[r["list"]] = r["count"]
    return held


def _asked(
    scratch: Scratch, stored: DataFrame, shared: Broadcast, dimension: int, probes: int
) -> DataFrame:
    """query (its row), q_id, q, list and place, from 0, of each list that a query looks into."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, _ = shared.value
        for batch in batches:
            if batch.num_rows:
                near = lists.nearest(_matrix(batch.column("q"), dimension), probes)
                arrays = [*batch.columns, pa.array(list(near), pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["query", "q_id", "q", "lists"])

    of_v = stored.schema["v"].dataType.simpleString()
    asks = stored.filter("asks").select(
        F.col("row").alias("query"), F.col("id").alias("q_id"), F.col("v").alias("q")
    )
    probed = asks.mapInArrow(probe, f"query bigint, q_id bigint, q {of_v}, lists array<int>")
    return scratch.saved(
        probed.select("query", "q_id", "q", F.posexplode("lists").alias("place", "list"))
    )


@dataclass(frozen=True)
class _Meeting:
    """Blocks of a list's codes and blocks of the queries that look into it meet in tasks."""

    shared: Broadcast
    #: Codes in each list.
    held: np.ndarray
    dimension: int
    k: int
    index: Index

    def _blocks(self, counts: np.ndarray, most: int) -> Column:
        n = np.maximum(1, -(-counts // most)).astype(np.int32)
        return F.element_at(F.lit(n), F.col("list") + 1)

    def _together(
        self, codes: DataFrame, asked: DataFrame, work: Callable[..., pa.Table], columns: str
    ) -> DataFrame:
        """``asked`` has a column at if it names blocks; else it asks all of a list's."""

        def own(row: str, n: Column) -> Column:
            return F.pmod(F.xxhash64(row), n).cast("int")

        def every(n: Column) -> Column:
            return F.explode(F.sequence(F.lit(0), n - 1))

        of_codes = self._blocks(self.held, self.index.codes)
        of_queries = self._blocks(_in_lists(asked, len(self.held)), self.index.block)
        key = ["list", "at", "by"]
        left = codes.select("*", own("row", of_codes).alias("at"), every(of_queries).alias("by"))
        right = asked.select("*", own("query", of_queries).alias("by"))
        if "at" not in right.columns:
            right = right.select("*", every(of_codes).alias("at"))
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(work, columns)

    def _estimated(
        self, left: pa.Table, right: pa.Table
    ) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
        """For some queries at a time: which, lower bounds, ``reach`` and what to exclude.

        ``reach`` is the k-th smallest upper bound, or infinity where there are not k.
        """
        lists, rotation = self.shared.value
        centre = lists.centres[left["list"][0].as_py()]
        ids, q_ids = left["id"].to_numpy(), right["q_id"].to_numpy()
        bits = np.frombuffer(b"".join(left["code"].to_pylist()), np.uint8).reshape(len(ids), -1)
        norms, fit = left["norm"].to_numpy(), left["fit"].to_numpy()
        away = _matrix(right["q"].combine_chunks(), self.dimension) - centre
        for s in _slices(len(q_ids), len(ids)):
            gap = np.sqrt((away[s] ** 2).sum(1))
            unit = away[s] @ rotation / np.where(gap > 0, gap, 1)[:, None]
            product, error = estimate(bits, fit, unit, self.index.deviations)
            scale = 2 * norms[:, None] * gap[None]
            middle = norms[:, None] ** 2 + gap[None] ** 2 - scale * product
            low, high = middle - scale * error[:, None], middle + scale * error[:, None]
            same = ids[:, None] == q_ids[s][None]
            low[same] = high[same] = np.inf
            reach = np.full(len(gap), np.inf)
            if len(ids) >= self.k:
                reach = np.partition(high, self.k - 1, axis=0)[self.k - 1]
            yield s, low, reach + 1e-9 * (1 + reach), same

    def bounds(self, codes: DataFrame, asked: DataFrame) -> DataFrame:
        """query, list, at, low and reach of each block that may hold one of the nearest.

        low is the smallest lower bound of a squared distance, reach the k-th smallest upper
        bound; ``asked`` brings ``least``, what low must not exceed.
        """

        def work(left: pa.Table, right: pa.Table) -> pa.Table:
            found = [np.empty((0, 3))]
            if left.num_rows and right.num_rows:
                least = right["least"].to_numpy()
                for s, low, reach, _ in self._estimated(left, right):
                    lowest = low.min(0)
                    at = np.flatnonzero((lowest <= np.minimum(reach, least[s])) & np.isfinite(lowest))
                    found.append(np.stack([at + s.start, lowest[at], reach[at]], 1))
            at, low, reach = np.concatenate(found).T
            queries = right.take(pa.array(at.astype(np.int64))).select(["query", "list"])
            block = left["at"][0].as_py() if left.num_rows else 0
            columns = [*queries.columns, pa.array(np.full(len(at), block, np.int32)), pa.array(low), pa.array(reach)]
            return pa.table(columns, names=["query", "list", "at", "low", "reach"])

        return self._together(codes, asked, work, "query bigint, list int, at int, low double, reach double")

    def ranked(self, whole: DataFrame, asked: DataFrame) -> DataFrame:
        """The k nearest, from codes with their vectors and queries with the blocks they ask."""

        def work(left: pa.Table, right: pa.Table) -> pa.Table:
            out = {"query_id": [np.empty(0, np.int64)], "vec_id": [np.empty(0, np.int64)], "score": [np.empty(0)]}
            if left.num_rows and right.num_rows:
                ids, q_ids = left["id"].to_numpy(), right["q_id"].to_numpy()
                v, q = (_matrix(c.combine_chunks(), self.dimension) for c in (left["v"], right["q"]))
                least = right["least"].to_numpy()
                for s, low, reach, same in self._estimated(left, right):
                    wanted = (low <= np.minimum(reach, least[s])[None]) & ~same
                    for j in range(wanted.shape[1]):
                        at = np.flatnonzero(wanted[:, j])
                        exact = np.sqrt(((v[at] - q[s.start + j]) ** 2).sum(1))
                        best = np.lexsort((ids[at], exact))[: self.k]
                        out["query_id"].append(np.full(len(best), q_ids[s.start + j]))
                        out["vec_id"].append(ids[at][best])
                        out["score"].append(exact[best])
            return pa.table({c: np.concatenate(parts) for c, parts in out.items()})

        found = self._together(whole, asked, work, "query_id bigint, vec_id bigint, score double")
        best = Window.partitionBy("query_id").orderBy("score", "vec_id")
        ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= self.k)
        return ranked.select("query_id", "rank", "vec_id", "score")
