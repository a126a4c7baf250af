r"""MinHash near-dedup with tensored banding.

Two small collections of ``HALVES`` half keys, each of ``DEPTH`` minhashes, are
combined pairwise: table (i, j) has the key of half i of the first and half j of the
second. So HALVES ** 2 tables of 2 * DEPTH minhashes need only 2 * HALVES * DEPTH
minhashes (72 in place of 864). Two sets with similarity s share a key unless all
halves of one side differ: at 0.8 that happens to 4 pairs in 10,000, at 0.85 to 2 in 100,000.

1. Equal sets are one class from the start, represented by one row of its smallest id; only
   representatives get table keys, and only of half keys that two of them or more have.
   Keys are aggregated with partial sums; every member of a bucket is paired with the
   bucket's smallest member only.
2. The pairs are confirmed on full sets; connected components join the links.
3. What a bucket still holds in other components is compared exactly: for each
   bucket's smallest member c, its unlinked members meet the members of the same
   family whose distance to c allows a link (the Jaccard distance is a metric, so
   distances to c must not differ by more than 1 - s): in large families first with
   members near c as centres, a row for each member, then in blocks of bounded size.
   Pairs that are in one component already are skipped, nothing else is.

So no link between texts that share a key is lost and no bucket is capped. A family of n
members costs n rows a round; only what no centre has joined, n_open members, costs
n * n_open / BLOCK rows. One path serves all sizes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from xxhash import xxh3_64_intdigest, xxh3_128

from rupaka.llm.common import MIX, Bitmap, Scratch, id_text, mix, released, table, window_hashes, word_hashes, written
from rupaka.llm.components import components

HALVES, DEPTH, SEED = 12, 3, 20240607
#: Members of one block in step 3, and rounds of centres before blocks.
BLOCK, ROUNDS = 128, 3


def shingles(text: str | None, size: int) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles: A-Z lower-cased, words [^\x20\x09-\x0D]+; with fewer words the whole sequence is one shingle."""
    data = (text or "").encode().lower()  # bytes.lower() changes A-Z only
    h = word_hashes(data)
    if 0 < len(h) < size:
        return np.array([xxh3_64_intdigest(b" ".join(data.split()))], np.uint64)
    return np.unique(window_hashes(h, size))


@lru_cache(maxsize=4)
def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    """An odd factor and a mask for each of n minhash functions."""
    rng = np.random.default_rng(SEED)
    odd, flip = (rng.integers(0, 1 << 63, (n, 1), dtype=np.uint64) for _ in range(2))
    return odd * np.uint64(2) + np.uint64(1), flip


def half_keys(sets: np.ndarray, halves: int = HALVES, depth: int = DEPTH) -> np.ndarray:
    """The 2 * halves half keys of a set of hashes."""
    odd, flip = _functions(2 * halves * depth)
    least = np.full(len(odd), np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(sets), 1 << 12):
        x = (sets[None, i : i + (1 << 12)] ^ flip) * odd
        least = np.minimum(least, (x ^ (x >> np.uint64(32))).min(axis=1))
    least = least.reshape(2 * halves, depth)
    key = np.zeros(2 * halves, np.uint64)
    for k in range(depth):
        key = mix(key * MIX + least[:, k])
    return key


def signatures(docs: DataFrame, size: int, halves: int = HALVES, depth: int = DEPTH) -> DataFrame:
    """doc_id, tag, n_shingles, set_hash (16 bytes in hexadecimal), keys (array of half keys) of (doc_id, tag, text). Empty sets have null hash and keys."""
    schema = pa.schema([("doc_id", pa.int64()), ("tag", pa.string()), ("n_shingles", pa.int64()), ("set_hash", pa.string()), ("keys", pa.list_(pa.int64()))])

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, tag, t in zip(b.column("doc_id").to_pylist(), b.column("tag").to_pylist(), b.column("text")):
                s = shingles(t.as_py(), size)
                found = (len(s), xxh3_128(s.tobytes()).hexdigest(), half_keys(s, halves, depth).view(np.int64)) if len(s) else (0, None, None)
                out.append((i, tag, *found))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, schema.types)], schema=schema)

    return docs.mapInArrow(run, "doc_id long, tag string, n_shingles long, set_hash string, keys array<long>")


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    """rep, shingles (array of hashes, sorted as unsigned numbers) of (doc_id, text)."""
    schema = pa.schema([("rep", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = max(1, b.num_rows * 8 * 600 // (32 << 20))
            for part in (b.slice(k, -(-b.num_rows // n)) for k in range(0, b.num_rows, -(-b.num_rows // n))):
                sets = [shingles(t.as_py(), size).view(np.int64) for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sets, schema.types[1])], schema=schema)

    return docs.mapInArrow(run, "rep long, shingles array<long>")


def _block_links(rows: DataFrame, percent: int) -> DataFrame:
    """a, b: the links between members of a block pair. rows: c, ub, mb (the block pair), open, rep, comp, near (distance to c), shingles."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    limit = 1 - percent / 100 + 1e-9

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, left = None, []

        def compare(row: tuple) -> list[tuple[int, int]]:
            rep, comp, near, s = row
            out, n = [], len(s)
            for r, c, d, t in left:
                if c != comp and abs(d - near) <= limit and 100 * min(n, len(t)) >= percent * max(n, len(t)):
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    if 100 * both >= percent * (n + len(t) - both):
                        out.append((max(r, rep), min(r, rep)))
            return out

        for b in batches:
            links = []
            cols = [b.column(k).to_pylist() for k in ("c", "ub", "mb", "open", "rep", "comp", "near")]
            for c, ub, mb, open_, rep, comp, near, s in zip(*cols, b.column("shingles")):
                if (c, ub, mb) != block:
                    block, left = (c, ub, mb), []
                row = (rep, comp, near, np.asarray(s.values))
                if open_:
                    left.append(row)
                else:
                    links += compare(row)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links)], schema=schema)

    return rows.repartition("c", "ub", "mb").sortWithinPartitions("c", "ub", "mb", F.desc("open")).mapInArrow(run, "a long, b long")


def candidates(reps: DataFrame, halves: int, kept: Scratch) -> DataFrame:
    """rep, c: every member of a table's bucket with the bucket's smallest member. reps: rep, keys.

    Two sets share the key of table (i, j) only if they share half i of the first and
    half j of the second collection. So the half keys that two sets or more have are
    found first, and only those are combined: the tables are the same, without the keys that
    only one set has.
    """
    each = reps.select("rep", F.posexplode("keys").alias("half", "key")).select("rep", "half", F.xxhash64("half", "key").alias("key"))
    shared = kept(each.groupBy("key").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a < b").select(F.col("key").alias("k")))
    held = each.join(shared, F.col("key") == F.col("k")).groupBy("rep").agg(F.collect_set(F.struct("half", "key")).alias("held"))
    held = kept(held)
    side = lambda first: F.filter("held", lambda h: (h.half < halves) == F.lit(first))
    tables = F.flatten(F.transform(side(True), lambda x: F.transform(side(False), lambda y: F.xxhash64(x.key, y.key))))
    # a row becomes up to halves ** 2: rows are dealt out by a hash of their own, which no other step has, so that every task gets its share
    n = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = held.repartition(n, F.xxhash64("rep", F.lit(SEED))).select("rep", F.explode(tables).alias("key"))
    heads = kept(keys.groupBy("key").agg(F.min("rep").alias("c"), F.max("rep").alias("last")).filter("c < last").select(F.col("key").alias("k"), "c"))
    return kept(keys.join(heads, F.col("key") == F.col("k")).filter("rep > c").select("rep", "c").distinct())


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int, kept: Scratch) -> DataFrame:
    """c, rep, linked, near (the Jaccard distance) of pairs (rep, c), by their full sets."""
    both = F.size(F.array_intersect("shingles", "c_shingles"))
    heads = sets.select(F.col("rep").alias("h"), F.col("shingles").alias("c_shingles"))
    met = pairs.join(sets.withColumnRenamed("rep", "r"), F.col("rep") == F.col("r")).join(heads, F.col("c") == F.col("h"))
    met = met.select("c", "rep", both.alias("both"), (F.size("shingles") + F.size("c_shingles")).alias("sum"))
    either = F.col("sum") - F.col("both")
    return kept(met.select("c", "rep", (100 * F.col("both") >= percent * either).alias("linked"), (1 - F.col("both") / either).alias("near")))


def _families(pairs: DataFrame, comp: DataFrame, kept: Scratch) -> DataFrame:
    """The members of families that hold several components: c, rep, near, comp, c_comp, n (members), n_open (those outside c's component)."""
    of = lambda col: comp.select(F.col("node").alias(f"{col}_node"), F.col("component").alias(f"{col}_comp"))
    member = pairs.join(of("rep"), F.col("rep") == F.col("rep_node"), "left").join(of("c"), F.col("c") == F.col("c_node"), "left")
    member = kept(member.select("c", "rep", "near", F.coalesce("rep_comp", "rep").alias("comp"), F.coalesce("c_comp", "c").alias("c_comp")))
    size = member.groupBy("c").agg(F.count("*").alias("n"), F.count_if(F.col("comp") != F.col("c_comp")).alias("n_open"))
    size = kept(size.filter("n_open > 0 and n > 1").select(F.col("c").alias("family"), "n", "n_open"))
    return kept(member.join(size, F.col("c") == F.col("family")).drop("family"))


def family_links(pairs: DataFrame, sets: DataFrame, links: DataFrame, comp: DataFrame, percent: int, kept: Scratch) -> DataFrame:
    """a, b: links between components that the pairs with smallest members left out; what joins no components isn't looked for. comp: the components of links.

    A family is a smallest member c and its bucket mates. In large families the member
    nearest to c, as a centre, is compared with all members of other components, once a
    round: a family of copies of one text, unlike each other but like the text, is done
    after that. What still is in several components after ``ROUNDS`` rounds, and small
    families, are compared in blocks of BLOCK members.
    """
    found, used = links.limit(0), pairs.select("c", F.col("c").alias("head")).limit(0)
    member = _families(pairs, comp, kept)
    for _ in range(ROUNDS):
        large = member.filter(F.col("n") > BLOCK)
        if large.isEmpty():
            break
        fresh = large.join(used.select(F.col("c").alias("uc"), "head"), (F.col("c") == F.col("uc")) & (F.col("rep") == F.col("head")), "left_anti")
        heads = kept(fresh.groupBy("c").agg(F.min(F.struct("near", "rep", "comp")).alias("h")).select(F.col("c").alias("hc"), F.col("h.rep").alias("head"), F.col("h.near").alias("h_near"), F.col("h.comp").alias("h_comp")))
        asked = large.join(heads, F.col("c") == F.col("hc")).filter((F.col("comp") != F.col("h_comp")) & (F.abs(F.col("near") - F.col("h_near")) <= 1 - percent / 100 + 1e-9))
        asked = kept(asked.select("rep", F.col("head").alias("c")).distinct())
        found = kept(found.union(confirmed(asked, sets, percent, kept).filter("linked").select(F.col("rep").alias("a"), F.col("c").alias("b"))))
        used = kept(used.union(heads.select(F.col("hc").alias("c"), "head")))
        member = _families(pairs, components(links.union(found), kept), kept)
    salt = lambda col, n: F.pmod(F.xxhash64(F.col(col), F.lit(3)), F.ceil(F.col(n) / BLOCK)).cast("int")
    blocks = lambda n: F.explode(F.sequence(F.lit(0), (F.ceil(F.col(n) / BLOCK) - 1).cast("int")))
    opened = member.filter("comp != c_comp").select("c", salt("rep", "n_open").alias("ub"), blocks("n").alias("mb"), F.lit(True).alias("open"), "rep", "comp", "near")
    every = member.select("c", blocks("n_open").alias("ub"), salt("rep", "n").alias("mb"), F.lit(False).alias("open"), "rep", "comp", "near")
    rows = opened.union(every).join(sets.withColumnRenamed("rep", "r"), F.col("rep") == F.col("r")).drop("r")
    return kept(found.union(_block_links(rows, percent)).distinct())


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, halves: int = HALVES, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable), kept (doc_id = component_id), for every row of docs.

    Two documents are linked if 100 * intersection >= percent * union of their sets of
    ``shingle``-word shingles. Texts that are null, empty or without words have empty sets
    and are linked with nothing. Ids should be unique and not null: rows with a null id
    have a null component and are kept; of rows that share an id each gets the component
    of its own text (rows repeated as a whole: the same one). Tables without rows give none. Runs
    when called; the result is a table in the shared folder.
    """
    spark = docs.sparkSession
    d = id_text(docs, id_col, text_col).withColumn("tag", F.md5(F.col("text").cast("binary")))
    with Scratch(spark) as kept:
        sig = kept(signatures(d, shingle, halves, depth))
        full = sig.filter("set_hash is not null and doc_id is not null")
        # written, so that what joins it later is two plain shuffles: Spark splits those where one text has very many copies.
        # A class is named by a number of its own, since several may belong to one id; numbers rise with the ids, so that a
        # bucket's smallest member is its first document, which is often the one that others are copies of
        classes = full.groupBy(F.col("set_hash").alias("set")).agg(F.min(F.struct("doc_id", "tag")).alias("first"))
        classes = classes.select("set", F.col("first.doc_id").alias("first_id"), F.col("first.tag").alias("first_tag")).orderBy("first_id", "first_tag")
        classes = kept(classes.withColumn("node", F.monotonically_increasing_id()))
        is_first = (F.col("doc_id") == F.col("first_id")) & (F.col("tag") == F.col("first_tag"))
        reps = full.join(classes, is_first & (F.col("set_hash") == F.col("set"))).select(F.col("node").alias("rep"), "keys")
        stars = candidates(reps, halves, kept)
        nodes = stars.select("rep").union(stars.select("c")).distinct()
        wanted = kept(nodes.join(classes, F.col("rep") == F.col("node")).select("first_id", "first_tag", "node"))
        # ids that surely aren't wanted go before the join, so that only candidates' texts are shuffled
        texts = Bitmap(wanted, "first_id", kept).marked(d, "doc_id").filter("marked").groupBy("doc_id", "tag").agg(F.min("text").alias("text"))
        sets = kept(full_sets(texts.join(wanted, is_first).select(F.col("node").alias("doc_id"), "text"), shingle))
        pairs = confirmed(stars, sets, percent, kept)
        links = kept(pairs.filter("linked").select(F.col("rep").alias("a"), F.col("c").alias("b")))
        comp = components(links, kept)
        more = family_links(pairs.select("c", "rep", "near"), sets, links, comp, percent, kept)
        comp = comp if more.isEmpty() else components(links.union(more), kept)
        # a component has the name of its smallest id
        linked = kept(classes.select("node", "first_id").join(comp.withColumnRenamed("node", "x"), F.col("node") == F.col("x")).drop("x"))
        least = linked.groupBy(F.col("component").alias("whole")).agg(F.min("first_id").alias("component_id"))
        least = linked.join(least, F.col("component") == F.col("whole")).select(F.col("node").alias("x"), "component_id")
        final = kept(classes.join(least, F.col("node") == F.col("x"), "left").select("set", F.coalesce("component_id", "first_id").alias("component_id")))
        named = full.select("doc_id", "n_shingles", "set_hash").join(final, F.col("set_hash") == F.col("set")).select("doc_id", "n_shingles", "component_id")
        alone = sig.filter("set_hash is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
        return written(named.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


#: All links by the shingles that two documents share, then their closure.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
                                   ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM w),
e AS (SELECT doc_id, unnest(s) AS g, len(s) AS n FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id
                                                               AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id AS x, doc_id AS y FROM s UNION SELECT r.x, l.b FROM r JOIN l ON r.y = l.a),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c ON x = doc_id
"""

QUERIES = {"op2_minhash_dedup": op2_minhash_dedup}
ORACLES = {"op2_minhash_dedup": SQL}
