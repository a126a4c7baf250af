r"""Embedding near-dedup by product quantisation.

1. Rows with equal vectors are one class with a count. Coarse centres and the codebooks of
   residual subspaces are fitted on a bounded sample (SAMPLE classes by a hash); every class
   is then coded: its cell (inverted list), a code of PARTS bytes, and its code's error, the
   exact distance between the vector and what the code stands for. Classes with equal cell
   and code are one entry of a list, with the largest error among them.
2. Each vector visits the lists of its cell and of all cells that a linked vector may be
   in. Unit vectors are linked within the distance r = sqrt(2 - 2 cos). A neighbour lies in
   cell B rather than in the vector's own cell A only if it is displaced towards B by
   (d(x, B)^2 - d(x, A)^2) / (2 |A - B|); cells where that is over ``reach`` r are left out.
   With reach 1 nothing can be missed; by default it is SIGMAS / sqrt(dimensions), so many
   standard deviations of a displacement of length r in a random direction, 1 at most.
3. In a list, table lookups give the distance D of the vector to each entry (asymmetric: only
   the entry is coded). By the triangle inequality all members of an entry are linked if
   D + error <= r, none is if D - error > r; what is left is compared exactly, by cosine of
   the whole vectors. So the codes lose no link and make none up, and a tight group of near
   copies costs a row per vector and entry, not one per pair.
4. Counts are summed per vector. Of links only what joins something is written: a spanning
   forest of each task's own links, then components over them.

Lists stand in shards of bounded size, several cells or a part of one; a vector is sent once to
each shard that it visits. Askers of a shard, members and askers of an entry are split
by a hash, so no cell or entry is a hot task or must fit in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from rupaka.llm.common import Scratch, released, small_batches, table, written
from rupaka.llm.components import components

#: Classes in the sample; cells at least and at most; subspaces; codes of a subspace.
SAMPLE, CELLS, PARTS, CODES = 1 << 14, (16, 1024), 8, 256
#: Entries and askers of a block of the lists; members and askers of a block of an entry.
LIST, ASKERS, MEMBERS, PAIRED = 1 << 13, 1 << 14, 1 << 12, 1 << 14
SIGMAS, ROUNDS, SEED = 3.0, 8, 20240611
#: Distances computed at once, and what tables in single precision may be off.
AT_ONCE, SLIP = 1 << 22, 2e-3


def rows_of(column: pa.Array) -> list[np.ndarray]:
    return [np.asarray(v.values, dtype=float) for v in column]


def unit(rows: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``width`` components of unit vectors in the rows' directions, and the length of what lies beyond."""
    out, beyond = np.zeros((len(rows), width)), np.zeros(len(rows))
    for k, r in enumerate(rows):
        r = r / np.abs(r).max()
        r = r / np.sqrt(r @ r)
        out[k, : min(width, len(r))] = r[:width]
        beyond[k] = np.sqrt(r[width:] @ r[width:])
    return out, beyond


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances between rows."""
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * (x @ y.T), 0)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    step = max(1, AT_ONCE // max(1, len(centres)))
    return np.concatenate([squares(x[i : i + step], centres).argmin(1) for i in range(0, len(x), step)] or [np.empty(0, int)])


def means(x: np.ndarray, count: int, rng: np.random.Generator) -> np.ndarray:
    """k-means; centres that lose all rows stay where they are."""
    centres = x[rng.choice(len(x), min(count, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        mine = nearest(x, centres)
        n = np.bincount(mine, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, mine, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


class Model:
    """Coarse centres and, for each subspace (a range of components), the codebook of residuals."""

    def __init__(self, rows: list[np.ndarray], n_classes: int):
        rng = np.random.default_rng(SEED)
        width = max(map(len, rows))
        x, _ = unit(rows, width)
        cells = int(min(CELLS[1], max(CELLS[0], 2 * n_classes**0.5)))
        self.centres = means(x, cells, rng)
        residual = x - self.centres[nearest(x, self.centres)]
        edges = np.linspace(0, width, min(PARTS, width) + 1).astype(int)
        self.spans = list(zip(edges[:-1], edges[1:]))
        self.books = [means(residual[:, a:b], CODES, rng) for a, b in self.spans]
        self.width = width

    def coded(self, x: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and the squared distance of each row to its code."""
        residual = x - self.centres[cell]
        codes = np.stack([nearest(residual[:, a:b], book) for (a, b), book in zip(self.spans, self.books)], 1).astype(np.uint8)
        off = sum(((residual[:, a:b] - book[codes[:, k]]) ** 2).sum(1) for k, ((a, b), book) in enumerate(zip(self.spans, self.books)))
        return codes, off

    def squares_of(self, codes: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """The squared length of what each code of a cell stands for."""
        words = np.concatenate([book[codes[:, k]] for k, book in enumerate(self.books)], 1)
        return ((self.centres[cell] + words) ** 2).sum(1)

    def tables(self, x: np.ndarray) -> list[np.ndarray]:
        """The products of each row with every code word of each subspace, which hold in all cells: with the product with a cell's centre they sum to the product with a code."""
        return [(x[:, a:b] @ book.T).astype(np.float32) for (a, b), book in zip(self.spans, self.books)]


class Forest:
    """Which of some items are joined so far."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def joined(self, items: np.ndarray) -> list[tuple[int, int]]:
        """Joins all items; the pairs that were needed for it."""
        roots = np.unique(self.root[items])
        if len(roots) > 1:
            self.root[np.isin(self.root, roots)] = roots[0]
        return [(int(r), int(roots[0])) for r in roots[1:]]


def coded_classes(classes: DataFrame, model: Model, r: float, reach: float | None) -> DataFrame:
    """node, m, dim, vec, cell, gid (cell, dimension and code), error, square (of the code's vector), probes (cells to visit) of (node, m, vec)."""
    types = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.int32(), pa.binary(), pa.float64(), pa.float64(), pa.list_(pa.int32()))
    schema = pa.schema(zip(("node", "m", "dim", "vec", "cell", "gid", "error", "square", "probes"), types))
    apart = np.sqrt(squares(model.centres, model.centres))
    shared = classes.sparkSession.sparkContext.broadcast((model, apart))

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, apart = shared.value
        for b in batches:
            rows = rows_of(b.column("vec"))
            if not rows:
                continue
            x, beyond = unit(rows, model.width)
            dims = np.array([len(v) for v in rows], np.int32)
            far = squares(x, model.centres)
            cell = far.argmin(1).astype(np.int32)
            codes, off = model.coded(x, cell)
            share = np.minimum(1, SIGMAS / np.sqrt(dims)) if reach is None else np.full(len(rows), reach)
            near = far - far.min(1)[:, None] <= 2 * r * apart[cell] * share[:, None] + 1e-9
            gids = [c.tobytes() + d.tobytes() + k.tobytes() for c, d, k in zip(cell, dims, codes)]
            yield pa.RecordBatch.from_arrays(
                [b.column("node"), b.column("m"), pa.array(dims), b.column("vec"), pa.array(cell), pa.array(gids, pa.binary()), pa.array(np.sqrt(off + beyond**2)), pa.array(model.squares_of(codes, cell)), pa.array([np.flatnonzero(p).astype(np.int32) for p in near], schema.field("probes").type)],
                schema=schema,
            )

    return classes.mapInArrow(run, "node long, m long, dim int, vec array<double>, cell int, gid binary, error double, square double, probes array<int>")


#: What a task finds: links counted for node a; a link (a, b) that joins something; an entry all of whose members are joined; an entry whose members a must be compared with.
COUNT, LINK, HUB, UNSURE = range(4)
FOUND = pa.schema([("kind", pa.int8()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("gid", pa.binary())])


def found_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), FOUND.types)], schema=FOUND)


class List:
    """The entries of a block: (node, m, dim, gid, error, square)."""

    def __init__(self, entries: list[tuple], model: Model):
        self.gids = [e[3] for e in entries]
        self.hub, self.m, self.dim, self.error, self.square = (np.array([e[k] for e in entries]) for k in (0, 1, 2, 4, 5))
        raw = np.array([np.frombuffer(g, np.uint8) for g in self.gids])
        cell = raw[:, :4].copy().view(np.int32)[:, 0]
        order = np.argsort(cell, kind="stable")
        self.gids = [self.gids[i] for i in order]
        self.hub, self.m, self.dim, self.error, self.square, cell = (x[order] for x in (self.hub, self.m, self.dim, self.error, self.square, cell))
        self.codes = raw[order, 8:]
        starts = np.flatnonzero(np.diff(cell, prepend=-1))
        self.cells = list(zip(cell[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(cell)]))
        self.model, self.forest, self.hubs = model, Forest(len(cell)), set()

    def asked(self, some: list[tuple], r: float) -> list[tuple]:
        """FOUND rows of askers (node, dim, vec, cells)."""
        model, out = self.model, []
        x, beyond = unit([s[2] for s in some], model.width)
        dims, whole = np.array([s[1] for s in some]), (x * x).sum(1) + beyond**2
        tables, at_centre = model.tables(x), x @ model.centres.T
        visits = np.zeros(at_centre.shape, bool)
        for k, s in enumerate(some):
            visits[k, s[3]] = True
        sure_q, sure_e, unsure_q, unsure_e = [], [], [], []
        for cell, low, high in self.cells:
            asking, codes = np.flatnonzero(visits[:, cell]), self.codes[low:high]
            step = max(1, AT_ONCE // (high - low))
            for i in range(0, len(asking), step):
                q = asking[i : i + step]
                product = sum((t[q][:, codes[:, k]] for k, t in enumerate(tables)), at_centre[q, cell].astype(np.float32)[:, None])
                far = np.sqrt(np.maximum(whole[q][:, None] + self.square[low:high] - 2 * product, 0))
                maybe = (self.dim[low:high] == dims[q][:, None]) & (far - self.error[low:high] <= r + SLIP)
                a, e = np.nonzero(maybe)
                sure = far[a, e] + self.error[low:high][e] <= r - SLIP
                sure_q.append(q[a[sure]])
                sure_e.append(low + e[sure])
                unsure_q.append(q[a[~sure]])
                unsure_e.append(low + e[~sure])
        sure_q, sure_e, unsure_q, unsure_e = (np.concatenate(v) if v else np.empty(0, int) for v in (sure_q, sure_e, unsure_q, unsure_e))
        order = np.argsort(sure_q, kind="stable")
        sure_q, sure_e = sure_q[order], sure_e[order]
        starts = np.flatnonzero(np.diff(sure_q, prepend=-1))
        for low, high in zip(starts, [*starts[1:], len(sure_q)]):
            node, at = some[sure_q[low]][0], sure_e[low:high]
            out.append((COUNT, node, None, int(self.m[at].sum()), None))
            out.append((LINK, node, int(self.hub[at[0]]), None, None))
            out += [(LINK, int(self.hub[p]), int(self.hub[q]), None, None) for p, q in self.forest.joined(at)]
        for e in set(sure_e.tolist()) - self.hubs:
            self.hubs.add(e)
            out.append((HUB, None, int(self.hub[e]), None, self.gids[e]))
        return out + [(UNSURE, some[q][0], None, None, self.gids[e]) for q, e in zip(unsure_q.tolist(), unsure_e.tolist())]


def looked_up(rows: DataFrame, model: Model, r: float) -> DataFrame:
    """FOUND rows of lists and their askers. rows: shard, ask, asks (bool), node, m, dim, vec, gid, error, square, probes; entries before askers."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        block, entries, listed = None, [], None
        for b in batches:
            out, waiting = [], []
            keys = zip(*(b.column(c).to_pylist() for c in ("shard", "ask")))
            rest = zip(*(b.column(c).to_pylist() for c in ("asks", "node", "m", "dim", "gid", "error", "square")), b.column("vec"), b.column("probes"))
            for key, (asks, node, m, dim, gid, error, square, vec, probes) in zip(keys, rest):
                if key != block:
                    if waiting:
                        out += listed.asked(waiting, r)
                    block, entries, listed, waiting = key, [], None, []
                if not asks:
                    entries.append((node, m, dim, gid, error, square))
                elif entries:
                    listed = listed or List(entries, model)
                    waiting.append((node, dim, np.asarray(vec.values, dtype=float), np.asarray(probes.values)))
            if waiting:
                out += listed.asked(waiting, r)
            if out:
                yield found_rows(out)

    ranged = rows.repartition("shard", "ask").sortWithinPartitions("shard", "ask", "asks")
    return ranged.mapInArrow(run, "kind byte, a long, b long, n long, gid binary")


def compared(rows: DataFrame, least: float) -> DataFrame:
    """FOUND rows (counts and links) of entries' members and askers, by exact cosine. rows: gid, sub, ask, asks, node, m, vec; members before askers."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, members, matrix, forest = None, [], None, None

        def asked(some: list[tuple]) -> list[tuple]:
            nonlocal matrix, forest
            if not members:
                return []
            if matrix is None:
                matrix, forest = unit([v for *_, v in members], len(members[0][2]))[0], Forest(len(members))
            nodes, m = (np.array([x[k] for x in members]) for k in (0, 1))
            x, _ = unit([v for _, v in some], matrix.shape[1])
            out = []
            for i in range(0, len(some), max(1, AT_ONCE // len(members))):
                part = x[i : i + max(1, AT_ONCE // len(members))]
                linked = part @ matrix.T >= least
                for k, row in enumerate(linked):
                    at = np.flatnonzero(row)
                    if len(at):
                        node = some[i + k][0]
                        out.append((COUNT, node, None, int(m[at].sum()), None))
                        out.append((LINK, node, int(nodes[at[0]]), None, None))
                        out += [(LINK, int(nodes[p]), int(nodes[q]), None, None) for p, q in forest.joined(at)]
            return out

        for b in batches:
            out, waiting = [], []
            keys = zip(*(b.column(c).to_pylist() for c in ("gid", "sub", "ask")))
            rest = zip(*(b.column(c).to_pylist() for c in ("asks", "node", "m")), b.column("vec"))
            for key, (asks, node, m, vec) in zip(keys, rest):
                if key != block:
                    if waiting:
                        out += asked(waiting)
                    block, members, matrix, waiting = key, [], None, []
                v = np.asarray(vec.values, dtype=float)
                if asks:
                    waiting.append((node, v))
                else:
                    members.append((node, m, v))
            if waiting:
                out += asked(waiting)
            if out:
                yield found_rows(out)

    ranged = rows.repartition("gid", "sub", "ask").sortWithinPartitions("gid", "sub", "ask", "asks")
    return ranged.mapInArrow(run, "kind byte, a long, b long, n long, gid binary")


def blocks(col: str):
    """One row for each block."""
    return F.explode(F.sequence(F.lit(0), F.col(col).cast("int") - 1))


def own(col: str, count: str, salt: int):
    """The block a row is in."""
    return F.pmod(F.xxhash64(col, F.lit(salt)), F.col(count)).cast("int")


def near_vectors(vectors: DataFrame, least: float = 0.9, reach: float | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id (the smallest vec_id reachable), kept (vec_id = component_id), for every row.

    Two rows are linked if the cosine of their vectors is ``least`` (over 0) or more; vectors of
    different dimension never are. Rows whose vector is null, empty or zero or holds null or
    non-finite components are linked with nothing, and so are rows without an id: their
    component is null and they are kept. Rows repeated with one id count as rows, each with
    its own vector. No rows give none. Runs when called; the result is a table in the shared folder.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(F.col(vec_col), lambda x: x.cast("double")).alias("vec"))
    sound = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vec", lambda x: x != 0)
    v = v.withColumn("fine", F.coalesce(F.col("vec_id").isNotNull() & sound, F.lit(False)))
    v = v.select("vec_id", "vec", "fine", *(F.when(F.col("fine"), F.xxhash64("vec", F.lit(k))).alias(f"h{k}") for k in (1, 2)))
    r = (2 - 2 * least) ** 0.5
    with Scratch(spark) as kept:
        classes = v.filter("fine").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m"), F.first("vec").alias("vec"))
        classes = kept(classes.withColumn("node", F.monotonically_increasing_id()))  # written once, so it stays as it is
        sample = classes.orderBy(F.xxhash64("h1"), "h2").limit(SAMPLE).select("vec").collect()
        if not sample:
            return written(v.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")))
        model = Model([np.array(s.vec) for s in sample], classes.count())
        coded = kept(coded_classes(classes.select("node", "m", "vec"), model, r, reach))
        entries = kept(coded.groupBy("cell", "gid").agg(F.min("node").alias("node"), F.sum("m").alias("m"), F.count("*").alias("size"), F.first("dim").alias("dim"), F.max("error").alias("error"), F.max("square").alias("square")))
        # entries stand in order of their cells, in shards of LIST; a row for each cell, CELLS[1] at most, tells which shards have some of it
        counts = {c.cell: c.n for c in entries.groupBy("cell").agg(F.count("*").alias("n")).collect()}
        edges = np.concatenate([[0], np.cumsum([counts.get(c, 0) for c in range(len(model.centres))])]).tolist()
        ints = lambda values: F.array(*(F.lit(int(v)) for v in values))
        first, size = ints(edges[:-1]), ints(max(1, b - a) for a, b in zip(edges, edges[1:]))
        shard = ((F.get(first, F.col("cell")) + F.pmod(F.xxhash64("gid"), F.get(size, F.col("cell")))) / LIST).cast("int")
        ranges = F.array(*(F.sequence(F.lit(a // LIST), F.lit((b - 1) // LIST)) if b > a else F.array().cast("array<int>") for a, b in zip(edges, edges[1:])))
        visited = F.array_distinct(F.flatten(F.transform("probes", lambda c: F.get(ranges, c))))
        visits = coded.select("node", "dim", "vec", "probes", F.explode(visited).alias("shard"))
        parts = kept(visits.groupBy("shard").agg(F.ceil(F.count("*") / ASKERS).alias("asks_n")).withColumnRenamed("shard", "part"))
        none = lambda **kinds: (F.lit(None).cast(k).alias(c) for c, k in kinds.items())
        lists = entries.withColumn("shard", shard).join(parts, F.col("shard") == F.col("part"))
        lists = lists.select("shard", blocks("asks_n").alias("ask"), F.lit(False).alias("asks"), "node", "m", "dim", *none(vec="array<double>"), "gid", "error", "square", *none(probes="array<int>"))
        askers = visits.join(parts, F.col("shard") == F.col("part"))
        askers = askers.select("shard", own("node", "asks_n", 2).alias("ask"), F.lit(True).alias("asks"), "node", *none(m="long"), "dim", "vec", *none(gid="binary", error="double", square="double"), "probes")
        found = kept(looked_up(lists.union(askers), model, r))
        unsure = kept(found.filter(F.col("kind") == UNSURE).select(F.col("a").alias("node"), "gid"))
        wanted = unsure.groupBy("gid").agg(F.ceil(F.count("*") / PAIRED).alias("asks_n"))
        wanted = kept(wanted.join(entries.select("gid", F.ceil(F.col("size") / MEMBERS).alias("subs")), "gid").withColumnRenamed("gid", "wanted"))
        held = coded.select("gid", "node", "m", "vec")
        members = held.join(wanted, F.col("gid") == F.col("wanted")).select("gid", own("node", "subs", 1).alias("sub"), blocks("asks_n").alias("ask"), F.lit(False).alias("asks"), "node", "m", "vec")
        pairs = unsure.join(wanted, F.col("gid") == F.col("wanted")).select("gid", blocks("subs").alias("sub"), own("node", "asks_n", 2).alias("ask"), "node")
        pairs = pairs.join(coded.select(F.col("node").alias("x"), "vec"), F.col("node") == F.col("x"))
        pairs = pairs.select("gid", "sub", "ask", F.lit(True).alias("asks"), "node", F.lit(None).cast("long").alias("m"), "vec")
        exact = kept(compared(members.union(pairs), least))
        both = found.select("kind", "a", "b", "n").union(exact.select("kind", "a", "b", "n"))
        # every vector has found its own class as well
        totals = both.filter(F.col("kind") == COUNT).groupBy(F.col("a").alias("counted")).agg((F.sum("n") - 1).alias("n_links"))
        hubs = found.filter(F.col("kind") == HUB).groupBy(F.col("gid").alias("hub")).agg(F.min("b").alias("b"))
        joined = coded.select("gid", "node").join(hubs, F.col("gid") == F.col("hub")).select(F.col("node").alias("a"), "b")
        links = both.filter(F.col("kind") == LINK).select("a", "b").union(joined)
        comp = components(links, kept)
        named = classes.select("h1", "h2", "rep", "m", "node").join(comp.withColumnRenamed("node", "known"), F.col("node") == F.col("known"), "left")
        named = named.withColumn("component", F.coalesce("component", "node"))
        least_id = named.groupBy(F.col("component").alias("whole")).agg(F.min("rep").alias("component_id"))
        named = named.join(least_id, F.col("component") == F.col("whole")).join(totals, F.col("node") == F.col("counted"), "left")
        named = kept(named.select(F.col("h1").alias("c1"), F.col("h2").alias("c2"), "component_id", F.coalesce("n_links", F.col("m") - 1).alias("n_links")))
        out = v.drop("vec").join(named, (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")), "left")
        out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        return written(out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


#: All pairs, then their closure.
SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
f AS (SELECT vec_id, v FROM v WHERE vec_id IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM f a JOIN f b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9),
r AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.b FROM r JOIN l ON r.y = l.a),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM v LEFT JOIN n ON a = vec_id LEFT JOIN c ON x = vec_id
"""

QUERIES = {"op11_embedding_dedup": op11_embedding_dedup}
ORACLES = {"op11_embedding_dedup": SQL}
