"""Exact top-k search by inner product: a Voronoi join.

Vectors and queries go to the cell of their nearest pivot. Each cell is summed
up by its count, its radius and the few distances nearest to its pivot. From
the summaries alone follow, for the queries of each cell, a floor under their
k-th best score and a ceiling over the scores of each cell, as a function of a
vector's distance to its pivot.

Cells that are near each other share a chunk, and large cells have several.
Each vector that some query may need moves once, to its chunk; a query is
replicated to the chunks that hold cells it needs, and no others. A task holds
one chunk and streams queries past it; it hands on a row for each query with
its best k, and these are merged. As queries are a fixed part of all rows,
chunks grow with the table up to ``MOST_HELD`` rows, so that neither queries
nor results outgrow the vectors.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import staged

TOP, SCALE, EVERY = 10, 1024, 100
#: Pivots: the root of the rows, within bounds; and the rows (those with the smallest hashes of their ids) that they are chosen from.
FEWEST_PIVOTS, MOST_PIVOTS, SAMPLE = 16, 512, 4096
#: Rows of a chunk: a hundredth of all, within bounds; scores that a task works out at once.
CHUNK, MOST_HELD, SCORES = 8192, 1 << 18, 1 << 22
_LONG = (1 << 63) - 1


def quantised(rows: list, scale: int = SCALE) -> list[np.ndarray | None]:
    """floor(scale * x) of each vector as longs (clipped to their range); None if null or not all finite."""
    out = []
    for row in rows:
        if row is None or any(x is None for x in row):
            out.append(None)
            continue
        values = np.floor(scale * np.asarray(row, np.float64))
        if not np.isfinite(values).all():
            out.append(None)
            continue
        inside = np.abs(values) < 2.0**62
        out.append(values.astype(np.int64) if inside.all() else np.array([max(-_LONG, min(_LONG, int(v))) for v in values], np.int64))
    return out


def matrix(raw: list[bytes], width: int = 0) -> np.ndarray:
    """Vectors as rows; shorter ones are filled up with zeros."""
    rows = [np.frombuffer(r, "<i8") for r in raw]
    width = max([width, *map(len, rows)])
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: in doubles where they hold every sum, else in Python's integers."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    high = lambda x: max((abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))))
    if high(a) * high(b) * max(1, width) < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    exact = a.astype(object) @ b.T.astype(object)
    return np.clip(exact, -_LONG, _LONG).astype(np.int64)


def _pad(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, max(0, width - x.shape[1])))).astype(np.float64)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    width = max(x.shape[1], pivots.shape[1])
    x, p = _pad(x, width), _pad(pivots, width)
    square = (x * x).sum(1)[:, None] - 2 * (x @ p.T) + (p * p).sum(1)[None, :]
    return np.sqrt(np.maximum(square, 0))


def _choose(sample: np.ndarray, most: int) -> np.ndarray:
    """Pivots: different vectors of the sample, each as far as can be from those before."""
    chosen = [0]
    far = _distances(sample, sample[:1])[:, 0]
    while len(chosen) < most and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, _distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def top_k(
    vectors: DataFrame, k: int = TOP, every: int = EVERY, vec_id: str = "vec_id", embedding: str = "embedding",
    pivots: int | None = None, chunk: int | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query, ties to
    the smaller vec_id.

    Queries are the rows whose vec_id is divisible by ``every``, candidates all
    rows of another vec_id. Components are floor(1024 x). Vectors that are null
    or hold null or non-finite components, and rows without a vec_id, take no
    part. Shorter vectors are filled up with zeros. A query that is repeated is
    answered once, and one id with several vectors by the best of all; a
    repeated candidate is listed as often as it comes. Scores and components
    beyond longs are clipped to them. No rows give no rows. Other columns are
    ignored, whatever their names.
    """
    spark = vectors.sparkSession
    given = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"))
    given = given.where("vec_id is not null and embedding is not null")
    schema = pa.schema([("vec_id", pa.int64()), ("x", pa.binary())])

    def ints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = quantised(batch.column(1).to_pylist())
            rows = [(i, v.astype("<i8").tobytes()) for i, v in zip(batch.column(0).to_pylist(), found) if v is not None]
            ids, xs = zip(*rows) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(xs, pa.binary())], schema=schema)

    rows = given.mapInArrow(ints, "vec_id long, x binary")
    picked = rows.select("x", F.xxhash64("vec_id", "x").alias("h"), "vec_id").orderBy("h", "vec_id").limit(SAMPLE).collect()
    if not picked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if pivots is None:
        pivots = min(MOST_PIVOTS, max(FEWEST_PIVOTS, math.isqrt(given.count())))
    centres = _choose(matrix([bytes(r["x"]) for r in picked]), pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                x = matrix(some.column(1).to_pylist())
                far = _distances(x, centres)
                cell = far.argmin(1)
                norm = np.sqrt((x.astype(np.float64) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(x)), cell]), pa.array(norm)],
                    names=["vec_id", "x", "cell", "dist", "norm"],
                )

    placed = staged(rows.mapInArrow(assign, "vec_id long, x binary, cell int, dist double, norm double"))
    is_query = F.col("vec_id") % every == 0
    cells = {r["cell"]: r.asDict() for r in _summaries(placed, is_query, k).collect()}  # at most ``pivots`` rows
    total = sum(c["n"] for c in cells.values())
    size = chunk or min(MOST_HELD, max(CHUNK, -(-total // 100)))
    bounds = Bounds(cells, centres, k)
    asked = [c for c in sorted(cells) if cells[c]["queries"]]
    least = {c: bounds.least(c) for c in asked}  # for each cell with queries, an array over all cells
    first, several = _chunks(cells, centres, size)
    radius = np.array([cells[j]["radius"] if j in cells else -1.0 for j in range(len(centres))])
    # what any query needs of each cell, and the chunks that each cell's queries go to
    any_needs = np.min(np.stack([least[c] for c in asked]), axis=0) if asked else np.full(len(centres), np.inf)
    targets = {
        c: np.unique(np.concatenate([first[j] + np.arange(several[j]) for j in np.flatnonzero(least[c] <= radius)] or [np.zeros(0, np.int64)]))
        for c in asked
    }
    count = int((first + several).max(initial=1))
    keyed = pa.schema([("key", pa.int32()), ("query", pa.bool_()), ("vec_id", pa.int64()), ("x", pa.binary())])

    def to_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, cell, dist = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3))
            some = np.flatnonzero(dist >= any_needs[cell])
            mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
            key = first[cell] + (mixed % several[cell].astype(np.uint64)).astype(np.int64)
            take = pa.array(some)
            columns = [pa.array(key[some].astype(np.int32)), pa.array(np.zeros(len(some), bool)), batch.column(0).take(take), batch.column(1).take(take)]
            yield pa.RecordBatch.from_arrays(columns, schema=keyed)

    def replicated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column(2).to_numpy(zero_copy_only=False)
            for c in np.unique(cell).tolist():
                own, to = np.flatnonzero(cell == c), targets[c].astype(np.int32)
                step = max(1, 4096 // max(1, len(to)))
                for at in range(0, len(own), step):
                    take = pa.array(np.repeat(own[at : at + step], len(to)))
                    key = pa.array(np.tile(to, len(own[at : at + step])))
                    columns = [key, pa.array(np.ones(len(take), bool)), batch.column(0).take(take), batch.column(1).take(take)]
                    yield pa.RecordBatch.from_arrays(columns, schema=keyed)

    spec = "key int, query boolean, vec_id long, x binary"
    queries = placed.where(is_query).dropDuplicates(["vec_id", "x"]).select("vec_id", "x", "cell", "dist")
    dealt = placed.select("vec_id", "x", "cell", "dist").mapInArrow(to_chunks, spec).unionByName(queries.mapInArrow(replicated, spec))
    together = dealt.repartitionById(count, F.col("key")).sortWithinPartitions("key", "query")
    solved = together.mapInArrow(_solver(k), "query_id long, best array<struct<score:long,vec_id:long>>")
    # at most a row a chunk for each query
    best = F.array_sort(F.transform(F.flatten(F.collect_list("best")), lambda b: F.struct((-b["score"]).alias("s"), b["vec_id"].alias("vec_id"))))
    merged = solved.groupBy("query_id").agg(F.slice(best, 1, k).alias("best"))
    ranked = merged.select("query_id", F.posexplode("best").alias("at", "b"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.s")).alias("score"))


def _summaries(placed: DataFrame, is_query: F.Column, k: int) -> DataFrame:
    """A row a cell: n, radius, queries, query_radius, query_norm, and the k + 1 ids nearest to its pivot
    (near_ids) with their distances (near)."""

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            cell, dist, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
            for c in np.unique(cell):
                far, of = near.get(int(c), (np.zeros(0), np.zeros(0, np.int64)))
                far, of = np.concatenate([far, dist[cell == c]]), np.concatenate([of, ids[cell == c]])
                by = np.argsort(far, kind="stable")
                by = by[np.sort(np.unique(of[by], return_index=True)[1])[: k + 1]]  # an id's nearest row
                near[int(c)] = far[by], of[by]
        cells = np.repeat(np.array(list(near), np.int32), [len(far) for far, _ in near.values()])
        far = np.concatenate([np.zeros(0), *(v[0] for v in near.values())])
        of = np.concatenate([np.zeros(0, np.int64), *(v[1] for v in near.values())])
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(far), pa.array(of, pa.int64())], names=["cell", "far", "of"])

    nearest = placed.select("cell", "dist", "vec_id").mapInArrow(summary, "cell int, far double, of long")
    nearest = nearest.groupBy("cell", "of").agg(F.min("far").alias("far")).groupBy("cell")
    nearest = nearest.agg(F.slice(F.sort_array(F.collect_list(F.struct("far", "of"))), 1, k + 1).alias("found"))
    nearest = nearest.select("cell", F.col("found.far").alias("near"), F.col("found.of").alias("near_ids"))
    sizes = placed.groupBy("cell").agg(
        F.count("*").alias("n"), F.max("dist").alias("radius"), F.count_if(is_query).alias("queries"),
        F.max(F.when(is_query, F.col("dist"))).alias("query_radius"), F.max(F.when(is_query, F.col("norm"))).alias("query_norm"),
    )
    return sizes.join(nearest, "cell")


def _chunks(cells: dict, centres: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first chunk, number of chunks) of each cell. Cells follow each other by the distance of their
    pivots to the first one; small ones share a chunk of ``size`` rows, large ones have chunks of their own."""
    first, several = np.zeros(len(centres), np.int64), np.ones(len(centres), np.int64)
    at, held = -1, size
    for j in np.argsort(_distances(centres, centres[:1])[:, 0], kind="stable").tolist():
        n = cells[j]["n"] if j in cells else 0
        if n > size:
            several[j] = -(-n // size)
            first[j], at, held = at + 1, at + int(several[j]), size
        else:
            if held + n > size:
                at, held = at + 1, 0
            first[j], held = max(at, 0), held + n
    return first, several


class Bounds:
    """What the summaries say about the queries of a cell.

    A query q of cell c and a vector x of cell j: <q, x> = <q, p_j> + <q, x - p_j>, where the
    first lies within |q - p_c| |p_j| of <p_c, p_j> and the second within |q| |x - p_j| of 0.
    """

    def __init__(self, cells: dict, centres: np.ndarray, k: int) -> None:
        self.cells, self.k, self.p = cells, k, centres.astype(np.float64)
        self.length = np.sqrt((self.p * self.p).sum(1))
        self.there = np.array([j in cells for j in range(len(centres))])
        named = [(j, d, cell["near_ids"][i] if "near_ids" in cell else (j, i)) for j, cell in cells.items() for i, d in enumerate(cell["near"])]
        self.of = np.array([j for j, _, _ in named], np.int64)
        self.near = np.array([d for _, d, _ in named])
        places: dict = {}
        self.ids = np.array([places.setdefault(x, len(places)) for _, _, x in named], np.int64)
        self.n_ids = len(places)
        self.widest = max((c["radius"] for c in cells.values()), default=0.0)

    def least(self, c: int) -> np.ndarray:
        """For each cell, the least distance to its pivot at which a vector may be among the best of a query of cell c."""
        radius, norm = self.cells[c]["query_radius"], self.cells[c]["query_norm"]
        middle = self.p @ self.p[c]
        low = np.full(self.n_ids, -np.inf)  # an id in several cells counts once, by its best
        np.maximum.at(low, self.ids, (middle - radius * self.length)[self.of] - norm * self.near)
        floor = np.partition(low, len(low) - self.k - 1)[len(low) - self.k - 1] if len(low) > self.k else -np.inf  # one may be the query's own
        slack = 1e-9 * (norm * (self.length.max() + self.widest) + 1)
        high = middle + radius * self.length + slack
        need = (floor - high) / norm if norm > 0 else np.full(len(high), np.inf)
        return np.where(self.there, np.where(high >= floor, 0.0, need) * (1 - 1e-9), np.inf)


def _needed(members: list[int], cells: dict, centres: np.ndarray, k: int) -> dict[int, float]:
    """``Bounds.least`` for the queries of several cells."""
    bounds = Bounds(cells, centres, k)
    least = np.min(np.stack([bounds.least(c) for c in members]), axis=0)
    return {j: float(least[j]) for j in cells}


def _solver(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rows by chunk, vectors before queries, to each query's best k in the chunk; a task holds one chunk."""
    pairs = pa.list_(pa.struct([("score", pa.int64()), ("vec_id", pa.int64())]))

    def answers(ids: np.ndarray, x: np.ndarray, asks: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
        out: list[list[dict]] = [[] for _ in asks]
        for at in range(0, len(x), 1 << 14):
            part, own = x[at : at + (1 << 14)], ids[at : at + (1 << 14)]
            step = max(1, SCORES // max(1, len(part)))
            for i in range(0, len(q), step):
                for row, score in enumerate(_product(q[i : i + step], part), i):
                    may = np.flatnonzero(own != asks[row])
                    s = score[may]
                    if len(s) > k:
                        edge = np.partition(s, len(s) - k)[len(s) - k]
                        above = np.flatnonzero(s > edge)
                        tied = np.flatnonzero(s == edge)[: k - len(above)]  # rows are in order of their ids
                        may, s = may[np.r_[above, tied]], s[np.r_[above, tied]]
                    out[row] += [{"score": a, "vec_id": b} for a, b in zip(s.tolist(), own[may].tolist())]
        best = [sorted(found, key=lambda r: (-r["score"], r["vec_id"]))[:k] for found in out]
        return pa.RecordBatch.from_arrays([pa.array(asks), pa.array(best, pairs)], names=["query_id", "best"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, chunk = None, [], None
        for batch in batches:
            key, query = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "query"))
            edges = np.flatnonzero((np.diff(key) != 0) | (query[1:] != query[:-1])) + 1
            for a, b in zip(np.r_[0, edges], np.r_[edges, len(key)]):
                if a == b:
                    continue
                if key[a] != now:
                    now, held, chunk = key[a], [], None
                ids, raw = batch.column("vec_id").to_numpy()[a:b], batch.column("x").slice(a, b - a).to_pylist()
                if not query[a]:
                    held.append((ids, matrix(raw)))
                    continue
                if chunk is None and held:
                    chunk = _together(held)
                    held = []
                for i in range(0, len(ids) if chunk is not None else 0, 512):
                    yield answers(*chunk, ids[i : i + 512], matrix(raw[i : i + 512]))

    return run


def _together(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors) of a chunk in order of the ids."""
    ids, width = np.concatenate([i for i, _ in held]), max(x.shape[1] for _, x in held)
    x = np.concatenate([np.pad(x, ((0, 0), (0, width - x.shape[1]))) for _, x in held])
    order = np.argsort(ids, kind="stable")
    return ids[order], x[order]


SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e)::BIGINT AS score
  FROM (SELECT DISTINCT vec_id, e FROM v WHERE vec_id % {EVERY} = 0) q JOIN v ON q.vec_id <> v.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {TOP}
"""
