"""Exact top-k inner-product search with vector-approximation files.

A file is a bounded number of vectors with their cells: each component's cell
number in a uniform grid of the file.  Files are written once.  Blocks of
queries meet files as tiles of one shuffle.  In a tile, one product of the
cells and one of the cell widths bound every score from above; exact vectors
are then read in the order of their bounds until the kth exact score, which is
carried from file to file, exceeds every bound that is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entailis.llm.common import checkpoint, prepare

#: Cells of a component's grid in a file.
CELLS = 256
#: Bytes of exact vectors in one file, and of the queries of one block.
FILE_BYTES = 1 << 20
BLOCK_BYTES = 16 << 20
#: Queries bounded at once, and exact vectors read at once.
BOUNDED, READ = 256, 32
#: Products of integers below this bound are exact in doubles.
EXACT = 2**53
#: Vectors with a larger component have no cells: their bound is infinite and they are always read.
WILD = 2.0**400
LONG_MAX = 2**63 - 1

_PACK = "part int, dim int, b int, ids binary, x binary, cells binary, low binary, width binary"


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as doubles; infinite beyond their range."""
    with np.errstate(over="ignore"):
        return np.floor(x * scale)


def exact_row(x: np.ndarray, scale: int) -> list[int]:
    """floor(scale * x) of every component, whatever its size."""
    return [int(np.floor(v * scale)) if abs(v) < EXACT else int(v) * scale for v in x.tolist()]


class ApproximationFile:
    """Exact vectors, their cells, and the bounds that cells give."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, scale: int = 256, cells: int = CELLS, grid: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None):
        self.ids, self.x, self.scale, self.cells = ids, x, scale, cells
        q = integers(x, scale)
        self.wild = (np.abs(q) > WILD).any(1)
        self.exact = np.where(self.wild[:, None], 0.0, q)
        if grid is None:
            low, high = self.exact.min(0, initial=np.inf), self.exact.max(0, initial=-np.inf)
            width = np.maximum((high - low) / cells, 1e-9)
            grid = low, width, np.clip((self.exact - low) / width, 0, cells - 1).astype(np.uint8)
        self.low, self.width, self.cell = grid
        self.high = self.low + self.width * cells

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """An upper bound of the score of each query (integers as doubles) with each vector."""
        wild = (np.abs(queries) > WILD).any(1)
        queries = np.where(wild[:, None], 0.0, queries)
        scaled = queries * self.width
        most = np.maximum(np.abs(scaled).max(1, initial=0.0), 1e-300)
        centre = self.cell.astype(np.float32) + np.float32(0.5)
        total, n = np.abs(scaled).sum(1), queries.shape[1] + 8
        # Slack: rounding of sums of n products in single precision (cells) and in double (grid).
        slack = n * 2.0**-23 * total * (self.cells + 1) + n * 2.0**-50 * (np.abs(queries) @ np.maximum(np.abs(self.low), np.abs(self.high))) + 1e-6
        out = ((scaled / most[:, None]).astype(np.float32) @ centre.T).astype(np.float64) * most[:, None]
        out += (queries @ self.low + total * (0.5 + 2.0**-20) + slack)[:, None]
        out[:, self.wild] = np.inf
        out[wild] = np.inf
        return np.maximum(out, -9.223372036854774e18)  # scores are held at the ends of a long

    def search(self, query: np.ndarray, bound: np.ndarray, k: int, skip: int, best: list[tuple[int, int]] = ()) -> list[tuple[int, int]]:
        """The k best (score, id) of this file and of best, ties to smaller ids; the row with id ``skip`` takes no part."""
        best, done = list(best), 0
        at = np.flatnonzero(bound >= best[-1][0]) if len(best) == k else np.arange(len(bound))
        first = min(len(at), max(READ, 4 * k))
        part = at[np.argpartition(-bound[at], first - 1)[:first]] if first < len(at) else at
        order = part[np.argsort(-bound[part], kind="stable")]
        while done < len(at):
            if done >= len(order):
                order = at[np.argsort(-bound[at], kind="stable")]
            if len(best) == k and bound[order[done]] < best[-1][0]:
                break
            now = order[done : done + READ]
            done += len(now)
            found = zip(self._scores(query, now), self.ids[now].tolist(), strict=True)
            best = sorted([*best, *((s, i) for s, i in found if i != skip)], key=lambda x: (-x[0], x[1]))[:k]
        return best

    def _scores(self, query: np.ndarray, rows: np.ndarray) -> list[int]:
        """Exact scores of a query, given as it is, with some rows."""
        own, q = self.exact[rows], integers(query, self.scale)
        if not self.wild[rows].any() and np.abs(own).max(initial=0) * np.abs(q).max(initial=0) * max(1, len(q)) < EXACT:
            return (own @ q).astype(np.int64).tolist()
        q = exact_row(query, self.scale)
        return [max(-LONG_MAX, min(LONG_MAX, sum(a * b for a, b in zip(exact_row(x, self.scale), q, strict=True)))) for x in self.x[rows]]


def _packer(scale: int, file: bool):
    """Rows (vec_id, b, x) to packs of at most FILE_BYTES, of one dimension and block each."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        kept: dict[tuple[int, int], tuple[list[int], list[np.ndarray]]] = {}

        def put(dim: int, b: int) -> pd.DataFrame:
            ids, rows = kept.pop((dim, b))
            ids, x = np.array(ids, np.int64), np.array(rows, np.float64).reshape(len(ids), dim)
            row = [part, dim, b, ids.tobytes(), x.tobytes(), None, None, None]
            if file:
                made = ApproximationFile(ids, x, scale)
                row[5:] = made.cell.tobytes(), made.low.tobytes(), made.width.tobytes()
            return pd.DataFrame([row], columns=[c.split()[0] for c in _PACK.split(", ")])

        for batch in batches:
            for i, b, v in zip(batch["vec_id"], batch["b"], batch["x"], strict=True):
                ids, rows = kept.setdefault((len(v), b), ([], []))
                ids.append(i)
                rows.append(v)
                if len(ids) >= max(1, FILE_BYTES // (8 * max(1, len(v)))):
                    yield put(len(v), b)
        for key in list(kept):
            yield put(*key)

    return pack


def _vectors(row) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row.ids, np.int64)
    return ids, np.frombuffer(row.x, np.float64).reshape(len(ids), row.dim)


def _scanner(k: int, scale: int):
    """Rows of tiles, a tile's queries before its files, to the k best of each query in each tile."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tile, ids, x, q, best = None, [], [], None, []

        def close() -> pd.DataFrame:
            made = [(qid, tile[1], tile[2], nth, vec, score) for nth, (qid, got) in enumerate(zip(ids, best, strict=True)) for score, vec in got]
            return pd.DataFrame(made, columns=["query_id", "dim", "b", "nth", "vec_id", "score"])

        for batch in batches:
            for row in batch.itertuples(index=False):
                if tile != (row.part, row.dim, row.b):
                    if best:
                        yield close()
                    tile, ids, x, q, best = (row.part, row.dim, row.b), [], [], None, []
                own, vectors = _vectors(row)
                if row.side == 0:
                    ids += own.tolist()
                    x.append(vectors)
                    continue
                if not ids:
                    continue
                if q is None:  # in order, so that a query has the same place in every tile
                    x = np.concatenate(x)
                    order = sorted(range(len(ids)), key=lambda i: (ids[i], x[i].tobytes()))  # noqa: B023
                    ids, x = [ids[i] for i in order], x[order]
                    q, best = integers(x, scale), [[] for _ in ids]
                cell = np.frombuffer(row.cells, np.uint8).reshape(len(own), row.dim)
                file = ApproximationFile(own, vectors, scale, grid=(np.frombuffer(row.low), np.frombuffer(row.width), cell))
                for start in range(0, len(ids), BOUNDED):
                    bounds = file.bounds(q[start : start + BOUNDED])
                    top = bounds.max(1).tolist()
                    for j, bound in enumerate(bounds, start):
                        if len(best[j]) < k or top[j - start] >= best[j][-1][0]:
                            best[j] = file.search(x[j], bound, k, ids[j], best[j])
        if best:
            yield close()

    return scan


def top_k(vectors: DataFrame, is_query, k: int = 5, *, key: str = "vec_id", embedding: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query.

    is_query: a condition on ``key`` that names the queries among the vectors.
    Components x count as floor(scale * x).  Candidates are all rows of the
    query's dimension but those with its own id; vectors that are null, or that
    hold null or non-finite components, and null keys take no part; finite ones
    do, whatever their size.  Ties go to smaller ids; a repeated row counts as
    often as it occurs, a repeated query once.  Scores beyond the range of a
    long are held at its ends.  An empty table gives an empty result.

    Files of FILE_BYTES keep the partitions of the table; queries are dealt into
    blocks of about BLOCK_BYTES.  Each block is paired with each partition's
    files, which is a row of a shuffle; a task holds one block and one file.
    """
    spark = vectors.sparkSession
    prepare(spark, 4096)
    x = F.col(embedding).cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    base = vectors.select(F.col(key).cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))
    files = checkpoint(base.withColumn("b", F.lit(0)).mapInPandas(_packer(scale, True), _PACK))
    queries = base.where(is_query(F.col("vec_id"))).distinct()
    size = queries.agg(F.sum(F.size("x").cast("long") * 8 + 8)).first()[0] or 0
    parts = (files.agg(F.max("part")).first()[0] or 0) + 1
    blocks = max(1, -(-size // BLOCK_BYTES))
    queries = queries.withColumn("b", F.pmod(F.xxhash64("vec_id", "x"), F.lit(blocks)).cast("int"))
    queries = checkpoint(queries.mapInPandas(_packer(scale, False), _PACK))
    queries = queries.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("side", F.lit(0))
    tiles = queries.unionByName(files.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("side", F.lit(1)))
    keys = ["part", "dim", "b"]
    found = tiles.repartition(*keys).sortWithinPartitions(*keys, "side").mapInPandas(_scanner(k, scale), "query_id long, dim int, b int, nth int, vec_id long, score long")
    # At most k rows a query and tile; lists merge within groups of tiles, then across the groups.
    found = found.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64)))
    best = lambda c: F.slice(F.array_sort(c), 1, k).alias("top")
    one = ["query_id", "dim", "b", "nth"]
    lists = found.groupBy(*one, "part").agg(best(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))))
    lists = lists.groupBy(*one).agg(best(F.flatten(F.collect_list("top"))))
    ranked = lists.select("query_id", F.posexplode("top").alias("at", "x"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))
