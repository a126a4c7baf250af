"""Exact top-k search with a pivot-distance index.

Vectors are keyed by their nearest pivot and their distance to it, in rings (annuli)
around each pivot. For a query and a ring three bounds hold for every inner product:
with the ring's largest norm (Cauchy-Schwarz), with the query's distance to the pivot
(triangle inequality, through the squared distance), and with the pivot's own product
plus the ring's outer radius. A query visits rings in order of their bound, in
rounds; after each round its k-th best score so far cuts off all rings whose bound is
below it. So results are exact however badly the rings separate.

Pivots are fitted on a bounded sample; their number grows with the square root of the
number of vectors, up to PIVOTS. Every vector is indexed. The driver and the
broadcasts hold pivots and ring summaries, PIVOTS * RINGS rows at most. Rings are cut
into blocks of about BLOCK vectors by a hash of the id, so a vector that a third of
all rows share makes many blocks and no hot task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from rupaka.llm.common import small_batches, table, written

SAMPLE, LEAST, PIVOTS, RINGS, BLOCK = 4096, 16, 64, 8, 2048
#: Ranks of the rings that each round visits, in order of their bound.
ROUNDS = ((0, 1), (1, 8), (8, 64), (64, 1 << 30))
EXACT = float(1 << 53)


def scaled(vectors: DataFrame, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, vec (floor(scale * x) of each component, in doubles) of the vectors without null or non-finite components and with an id."""
    x = F.transform(F.col(vec_col), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))
    fine = F.forall(F.col(vec_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    return vectors.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).filter(fine).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("vec"))


def widened(rows: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for k, r in enumerate(rows):
        out[k, : min(width, len(r))] = r[:width]
    return out


def pivots_of(vectors: DataFrame, sample: int = SAMPLE, count: int | None = None) -> np.ndarray:
    """Up to ``count`` means of groups of a bounded sample, taken by a hash of the id; by default LEAST to PIVOTS, by the square root of the number of vectors."""
    count = count or int(min(PIVOTS, max(LEAST, (vectors.count() / RINGS) ** 0.5 / 8)))
    rows = [np.array(r.vec) for r in vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vec").collect()]
    if not rows:
        return np.zeros((1, 0))
    x = widened(rows, max(map(len, rows)))
    far = [0]
    near = ((x - x[0]) ** 2).sum(1)
    while len(far) < min(count, len(x)) and near.max() > 0:
        far.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[far[-1]]) ** 2).sum(1))
    p = x[far]
    for _ in range(5):
        mine = ((x[:, None] - p[None]) ** 2).sum(2).argmin(1)
        p = np.array([x[mine == k].mean(0) if (mine == k).any() else p[k] for k in range(len(p))])
    return p


def distances(rows: list[np.ndarray], p: np.ndarray) -> np.ndarray:
    """Euclidean distances to each pivot; components beyond a vector's or pivot's length count as zero."""
    out = np.empty((len(rows), len(p)))
    for i in range(0, len(rows), 1024):
        part = rows[i : i + 1024]
        x = widened(part, p.shape[1])
        beyond = np.array([float((r[p.shape[1] :] ** 2).sum()) for r in part])
        out[i : i + 1024] = np.sqrt(((x[:, None] - p[None]) ** 2).sum(2) + beyond[:, None])
    return out


def _vectors(column: pa.Array) -> list[np.ndarray]:
    return [np.asarray(v.values, dtype=float) for v in column]


def keyed(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Adds cell (nearest pivot), far (the distance to it) and norm."""
    schema = pa.schema([("vec_id", pa.int64()), ("vec", pa.list_(pa.float64())), ("cell", pa.int32()), ("far", pa.float64()), ("norm", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = _vectors(b.column("vec"))
            if rows:
                d = distances(rows, pivots)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("vec").cast(schema.types[1]), pa.array(d.argmin(1).astype(np.int32)), pa.array(d.min(1)), pa.array([float(np.sqrt((r * r).sum())) for r in rows])], schema=schema)

    return vectors.mapInArrow(run, "vec_id long, vec array<double>, cell int, far double, norm double")


def _bounds(queries: DataFrame, pivots: np.ndarray, rings: list) -> DataFrame:
    """query_id, cell, ring, rank, bound: the rings of each query in order of what their vectors can score."""
    cell, ring, low, high, norm = (np.array([r[k] for r in rings]) for k in range(5))
    schema = pa.schema([("query_id", pa.int64()), ("cell", pa.int32()), ("ring", pa.int32()), ("rank", pa.int32()), ("bound", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = _vectors(b.column("vec"))
            for i in range(0, len(rows), 512):
                part = rows[i : i + 512]
                d = distances(part, pivots)[:, cell]
                q = np.array([float(np.sqrt((r * r).sum())) for r in part])[:, None]
                gap = np.maximum(0, np.maximum(d - high, low - d))
                at_pivot = (q**2 + (pivots[cell] ** 2).sum(1) - d**2) / 2
                most = np.minimum(np.minimum(q * norm, (q**2 + norm**2 - gap**2) / 2), at_pivot + q * high)
                most += 1 + 1e-9 * (q * norm + q**2 + norm**2)  # what rounding may have taken
                order = np.argsort(-most, axis=1, kind="stable")
                n = len(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.asarray(b.column("vec_id"))[i : i + 512], len(cell))), pa.array(cell[order].ravel().astype(np.int32)), pa.array(ring[order].ravel().astype(np.int32)), pa.array(np.tile(np.arange(len(cell), dtype=np.int32), n)), pa.array(np.take_along_axis(most, order, 1).ravel())],
                    schema=schema,
                )

    return queries.mapInArrow(run, "query_id long, cell int, ring int, rank int, bound double")


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact integer inner products of integral rows; beyond 64 bits they stop at the ends of the range."""
    if not x.size or np.abs(x).max() * np.abs(y).max() * x.shape[1] < EXACT:
        return (x @ y.T).astype(np.int64)
    whole = [[int(v) for v in r] for r in y]
    dots = [[sum(a * b for a, b in zip([int(v) for v in r], s)) for s in whole] for r in x]
    return np.array([[max(-(1 << 63), min((1 << 63) - 1, v)) for v in r] for r in dots], np.int64)


def _search(rows: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score: each query's best k in each block that reach its floor. rows: cell, ring, sub, query (bool), id, vec, least."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, vecs, stacked = None, [], [], {}

        def best(asked: list[tuple[int, np.ndarray, int | None]]) -> list[tuple[int, int, int]]:
            out = []
            for dim in {len(v) for _, v, _ in asked}:
                if dim not in stacked:
                    at = [j for j, v in enumerate(vecs) if len(v) == dim]
                    stacked[dim] = np.array([ids[j] for j in at], np.int64), np.array([vecs[j] for j in at]).reshape(len(at), dim)
                own, x = stacked[dim]
                some = [a for a in asked if len(a[1]) == dim]
                if not len(own):
                    continue
                scores = products(np.array([v for _, v, _ in some]).reshape(len(some), dim), x)
                for (q, _, least), s in zip(some, scores):
                    at = np.flatnonzero((own != q) & (s >= (least if least is not None else s.min())))
                    for j in at[np.lexsort((own[at], -s[at]))][:k]:
                        out.append((q, int(own[j]), int(s[j])))
            return out

        for b in batches:
            found, asked = [], []
            for *new, query, i, v, least in zip(*(b.column(c).to_pylist() for c in ("cell", "ring", "sub", "query", "id")), b.column("vec"), b.column("least").to_pylist()):
                if new != key:
                    found += best(asked)
                    key, ids, vecs, stacked, asked = new, [], [], {}, []
                if query:
                    asked.append((i, np.asarray(v.values, dtype=float), least))
                    if len(asked) == 256:
                        found += best(asked)
                        asked = []
                else:
                    ids.append(i)
                    vecs.append(np.asarray(v.values, dtype=float))
            found += best(asked)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], schema=schema)

    return rows.repartition("cell", "ring", "sub").sortWithinPartitions("cell", "ring", "sub", "query").mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row with is_query(id) its k highest integer inner products with all other rows.

    Components are floor(scale * x). Ties go to the smaller id. Fewer than k candidates
    give fewer rows, none give none. Rows with a null id or vector, or with a null or non-finite
    component, take no part; vectors of another dimension than a query's are no candidates
    of it; rows that have a query's own id aren't either. Ids should be unique: rows that share an
    id are candidates of their own, and as queries their scores are ranked together.
    """
    small_batches(vectors.sparkSession)
    base = scaled(vectors, scale, id_col, vec_col)
    pivots = pivots_of(base)
    index = written(keyed(base, pivots))
    edge = {r.cell: (r.low, r.high) for r in index.groupBy("cell").agg(F.min("far").alias("low"), F.max("far").alias("high")).collect()}
    width = {c: max((high - low) / RINGS, 1e-9) for c, (low, high) in edge.items()}
    spread = F.create_map(*[F.lit(v) for c in edge for v in (c, edge[c][0])]) if edge else F.create_map().cast("map<int,double>")
    widths = F.create_map(*[F.lit(v) for c in edge for v in (c, width[c])]) if edge else F.create_map().cast("map<int,double>")
    index = index.withColumn("ring", F.least(F.lit(RINGS - 1), F.floor((F.col("far") - spread[F.col("cell")]) / widths[F.col("cell")])).cast("int"))
    rings = [tuple(r) for r in index.groupBy("cell", "ring").agg(F.min("far"), F.max("far"), F.max("norm"), F.count("*").alias("n")).orderBy("cell", "ring").collect()]
    subs = F.create_map(*[F.lit(v) for r in rings for v in (r[0] * RINGS + r[1], -(-r[5] // BLOCK))]) if rings else F.create_map().cast("map<int,int>")
    n_subs = subs[F.col("cell") * RINGS + F.col("ring")]
    data = index.withColumn("sub", F.pmod(F.xxhash64("vec_id"), n_subs).cast("int")).select("cell", "ring", "sub", F.lit(False).alias("query"), F.col("vec_id").alias("id"), "vec", F.lit(None).cast("long").alias("least"))
    asked = index.filter(is_query(F.col("vec_id"))).select(F.col("vec_id").alias("query_id"), "vec")
    best, kept = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"), None
    visits = written(_bounds(asked.select(F.col("query_id").alias("vec_id"), "vec"), pivots, rings)) if rings else asked.select("query_id", F.lit(0).alias("cell"), F.lit(0).alias("ring"), F.lit(0).alias("rank"), F.lit(0.0).alias("bound"))
    for low, high in ROUNDS:
        now = visits.filter((F.col("rank") >= low) & (F.col("rank") < high))
        if kept is None:
            now = now.withColumn("least", F.lit(None).cast("long"))
        else:
            floor_ = kept.filter(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
            now = written(now.join(floor_, "query_id", "left").filter("least is null or bound >= least"))
            if now.isEmpty():  # the bounds have cut off all that is left of these ranks, and so all behind them
                break
        now = now.join(asked, "query_id").withColumn("sub", F.explode(F.sequence(F.lit(0), n_subs.cast("int") - 1)))
        found = _search(data.union(now.select("cell", "ring", "sub", F.lit(True).alias("query"), "query_id", "vec", "least")), k)
        found = found if kept is None else found.union(kept.select("query_id", "vec_id", "score"))
        kept = written(found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
    return kept


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10
"""

QUERIES = {"op9_exact_topk": op9_exact_topk}
ORACLES = {"op9_exact_topk": SQL}
