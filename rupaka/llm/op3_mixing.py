"""Mixing sources to target weights: tempered shares, realised as budgeted block permutations.

The weight of a source is its token share to the power ``a``, normalised. Bisection
finds the exponent in [0, 1] at which the weights reach a target entropy; if a
source would then be repeated more often than the limit, bisection finds the
smallest exponent that respects the limit. Every source gets its weight of the
token budget: whole passes over the source, then, for what is left, blocks of
documents in an order permuted by a seeded hash. The block that doesn't fit any more
gives single documents in permuted order until the next would exceed the quota.

Only column expressions and DataFrame operations run. The bisection sends the
driver one row of sums for each of its steps, whatever the number of sources.
A source's documents are spread over blocks by their hash, so a hot source is no hot key.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from rupaka.llm.common import table, written

#: Sections of the exponent's interval that one step evaluates at once, and steps: the interval shrinks to 64 ** -6.
SECTIONS, STEPS = 64, 6
#: Target block size; blocks in all sources together, about; rows of a table of sources that are broadcast at most.
BLOCK_TOKENS, MOST_BLOCKS, FEW_SOURCES = 65_536, 1 << 20, 50_000
NO_SOURCE = "(none)"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def hashed(*parts: Column) -> Column:
    """A number below 2 ** 52 from the md5 of the parts; the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long")


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, n_tokens, spread (tells rows without an id apart; null for others) and the columns of ``keep``, named keep_*."""
    spread = F.when(F.col(id_col).isNull(), F.md5(F.col(text_col)))
    columns = F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit(NO_SOURCE)).alias("source"), n_words(F.col(text_col)).alias("n_tokens"), spread.alias("spread")
    return docs.select(*columns, *(F.col(c).alias(f"keep_{c}") for c in keep))


def _first_within(totals: DataFrame, all_tokens: int, good) -> float:
    """The smallest exponent in [0, 1] from which good(entropy, largest weight / share) holds, given that it holds at 1 and is monotone."""
    low, high = 0.0, 1.0
    for _ in range(STEPS):
        grid = [low + (high - low) * k / SECTIONS for k in range(SECTIONS + 1)]
        p = F.log(F.col("tokens") / F.lit(float(all_tokens)))
        a = F.col("a")
        rows = totals.withColumn("a", F.explode(F.array(*map(F.lit, grid)))).groupBy("a").agg(F.sum(F.exp(a * p)).alias("s"), F.sum(F.exp(a * p) * a * p).alias("t"), F.max((a - 1) * p).alias("r"))
        found = {r.a: good(math.log(r.s) - r.t / r.s, math.exp(r.r) / r.s) for r in rows.collect()}
        k = next((k for k, g in enumerate(grid) if found[g]), SECTIONS)
        if k == 0:
            return low
        low, high = grid[k - 1], grid[k]
    return high


def temperature(totals: DataFrame, evenness: float = 0.5, max_repeat: float = 4.0, budget: int | None = None) -> tuple[float, int, int, int]:
    """The exponent, the budget in tokens, all tokens and the number of sources; totals: source, tokens > 0.

    The target entropy lies ``evenness`` of the way from that of the plain shares (0)
    to that of equal weights (1). budget: tokens of the mix, by default those of the
    corpus, ``max_repeat`` times that at most; 0 stands for the smallest budget under
    which no source has fewer tokens than its documents hold, as far as the limit allows.
    """
    one = totals.agg(F.count("*").alias("k"), F.sum("tokens").alias("n"), F.max("tokens").alias("most")).first()
    if not one.k:
        return 1.0, 0, 0, 0
    plain = totals.agg(F.sum(-(F.col("tokens") / one.n) * F.log(F.col("tokens") / one.n)).alias("h")).first().h
    target = plain + evenness * (math.log(one.k) - plain)
    exponent = 1.0
    if one.k > 1:
        # entropy falls as the exponent grows: the largest exponent that still reaches the target is where it is first below
        exponent = _first_within(totals, one.n, lambda h, r: h <= target + 1e-12)
    fixed = min(budget or one.n, int(max_repeat * one.n))

    if budget == 0:
        # with every source kept whole the least repeated is the one with the largest share: the spread of weight / share is the repetition
        least = totals.agg(F.min("tokens").alias("m")).first().m
        if max_repeat < (one.most / least) ** (1 - exponent):
            exponent = min(1.0, 1 - math.log(max_repeat) / math.log(one.most / least))
        exponent = round(exponent, 6)
        s = totals.agg(F.sum(F.pow(F.col("tokens") / one.n, F.lit(exponent))).alias("s")).first().s
        return exponent, math.ceil(one.n * (one.most / one.n) ** (1 - exponent) * s), one.n, one.k
    limit = lambda h, r: r * fixed / one.n <= max_repeat + 1e-12
    return round(max(exponent, _first_within(totals, one.n, limit)), 6), fixed, one.n, one.k


def _with_sources(d: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows with the columns of their source. Sources that hold a FEW_SOURCES-th of all rows, of which there can't be more than that, are
    broadcast, and so are all if they are no more; any others are joined by a shuffle, none of them large enough to be a hot key."""
    one = sources.agg(F.count("*").alias("k"), F.sum("rows").alias("rows")).first()
    if one.k <= FEW_SOURCES:
        return d.join(F.broadcast(sources), "source")
    large = F.col("rows") * FEW_SOURCES >= one.rows
    most = d.join(F.broadcast(sources.filter(large)), "source")
    rest = d.join(F.broadcast(sources.filter(large).select("source")), "source", "left_anti")
    return most.unionByName(rest.join(sources.filter(~large), "source"))


def _placed(d: DataFrame, seed: int) -> DataFrame:
    """Adds a row's block, the block's place in the source's permutation (at) and the row's place in the block (h)."""
    d = d.withColumn("block", F.pmod(hashed(F.lit(seed), F.col("doc_id"), F.col("spread")), F.col("blocks")))
    return d.withColumn("at", hashed(F.lit(seed + 1), F.col("source"), F.col("block"))).withColumn("h", hashed(F.lit(seed + 2), F.col("doc_id"), F.col("spread")))


def _with_stops(d: DataFrame, t: DataFrame, seed: int) -> DataFrame:
    """Adds to each source where its last, partial pass stops: the first block that the quota doesn't hold (cut_at, cut_block), the room left there, and the
    first row of that block that goes beyond it (stop). Only narrow rows are aggregated; whole rows then need no shuffle, since what comes before is in."""
    narrow = d.select("doc_id", "source", "n_tokens", "spread").filter("n_tokens > 0")
    blocks = _placed(_with_sources(narrow, t), seed).groupBy("source", "at", "block").agg(F.sum("n_tokens").alias("n"), F.first("left").alias("left"))
    order = Window.partitionBy("source").orderBy("at", "block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    past = blocks.withColumn("room", F.col("left") - F.sum("n").over(order) + F.col("n")).filter("n > room")
    cuts = past.groupBy("source").agg(F.min(F.struct("at", "block", "room")).alias("c")).select("source", F.col("c.at").alias("cut_at"), F.col("c.block").alias("cut_block"), F.col("c.room").alias("room"))
    t = written(t.join(cuts, "source", "left"))
    # one block for each source, repeated rows as one
    inside = _placed(_with_sources(narrow, t), seed).filter("block = cut_block and room > 0").groupBy("source", "h", "doc_id").agg(F.sum("n_tokens").alias("n"), F.first("room").alias("room"))
    inner = Window.partitionBy("source").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    beyond = inside.withColumn("upto", F.sum("n").over(inner)).filter("upto > room")
    return written(t.join(beyond.groupBy("source").agg(F.min(F.struct("h", "doc_id")).alias("stop")), "source", "left"))


def mix(docs: DataFrame, evenness: float = 0.5, max_repeat: float = 4.0, budget: int | None = None, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """How often each document is in the mix: doc_id, source, n_tokens, weight, n_copies, block, and the columns of docs named in ``keep``.

    One row for each row of ``docs``; tokens are words. A null source counts as one
    source named NO_SOURCE. Null and empty texts have no tokens, cost nothing and
    are in every pass, at least once. Repeated rows are told apart by nothing and
    share their fate; rows without an id are dealt out by their texts. An empty table gives an empty result.
    Parameters: see temperature(); seed: of the permutations.
    """
    # narrow columns (and what is kept) and a row for each source, written down: the texts are read once, not in every step of the bisection
    d = written(sized(docs, id_col, text_col, source_col, keep))
    all_totals = written(d.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")))
    totals = all_totals.filter("tokens > 0")
    exponent, fixed, tokens, _ = temperature(totals, evenness, max_repeat, budget)
    share = F.pow(F.col("tokens") / F.lit(float(max(1, tokens))), F.lit(exponent))
    whole = totals.agg(F.sum(share).alias("whole")).first().whole or 1.0
    block = max(BLOCK_TOKENS, -(-tokens // MOST_BLOCKS))
    t = (
        all_totals.withColumn("weight", F.when(F.col("tokens") > 0, share / F.lit(whole)).otherwise(0.0))
        .withColumn("quota", F.floor(F.col("weight") * F.lit(fixed) + F.lit(1e-6)))
        .withColumn("passes", F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.greatest("tokens", F.lit(1)))).otherwise(1))
        .withColumn("left", F.when(F.col("tokens") > 0, F.col("quota") - F.col("passes") * F.col("tokens")).otherwise(0))
        .withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.lit(block))))
    )
    d = _placed(_with_sources(d, _with_stops(d, t, seed)), seed)
    whole_block = F.col("cut_at").isNull() | (F.struct("at", "block") < F.struct("cut_at", "cut_block"))
    within = (F.col("block") == F.col("cut_block")) & (F.col("room") > 0) & (F.struct("h", "doc_id") < F.col("stop"))
    last = F.when(F.col("n_tokens") == 0, F.col("passes") == 0).otherwise(whole_block | F.coalesce(within, F.lit(False)))
    copies = F.col("passes") + last.cast("long")
    return d.select("doc_id", "source", "n_tokens", F.round("weight", 9).alias("weight"), copies.cast("long").alias("n_copies"), F.col("block").cast("long").alias("block"), *(F.col(f"keep_{c}").alias(c) for c in keep))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


#: The bisection and the block permutations of mix() with its default parameters.
SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '{NO_SOURCE}') AS source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents),
tot AS (SELECT source, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY source),
s AS (SELECT sum(tokens)::DOUBLE AS n, count(*) AS k, list(tokens / (SELECT sum(tokens) FROM tot)::DOUBLE) AS p FROM tot WHERE tokens > 0),
goal AS (SELECT n, k, p, -list_sum(list_transform(p, lambda x: x * ln(x))) AS h FROM s),
search AS (
  SELECT 0 AS step, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0.0::DOUBLE AS rlo, 1.0::DOUBLE AS rhi
  UNION ALL
  SELECT step + 1,
         CASE WHEN e <= goal_h THEN lo ELSE mid END, CASE WHEN e <= goal_h THEN mid ELSE hi END,
         CASE WHEN rep <= 4.0 THEN rlo ELSE rmid END, CASE WHEN rep <= 4.0 THEN rmid ELSE rhi END
  FROM (SELECT search.*, (lo + hi) / 2 AS mid, (rlo + rhi) / 2 AS rmid, h + 0.5 * (ln(k) - h) + 1e-12 AS goal_h,
               ln(list_sum(list_transform(p, lambda x: pow(x, (lo + hi) / 2))))
               - list_sum(list_transform(p, lambda x: pow(x, (lo + hi) / 2) * ((lo + hi) / 2) * ln(x)))
                 / list_sum(list_transform(p, lambda x: pow(x, (lo + hi) / 2))) AS e,
               list_max(list_transform(p, lambda x: pow(x, (rlo + rhi) / 2 - 1)))
               / list_sum(list_transform(p, lambda x: pow(x, (rlo + rhi) / 2))) AS rep
        FROM search, goal WHERE step < 45)),
a AS (SELECT round(greatest(hi, CASE WHEN rhi < 1e-9 THEN 0 ELSE rhi END), 6) AS a FROM search WHERE step = 45),
w AS (SELECT source, tokens, pow(tokens / n, a) / (SELECT sum(pow(tokens / n, a)) FROM tot, s, a WHERE tokens > 0) AS weight,
             n::BIGINT AS n FROM tot, s, a WHERE tokens > 0),
q AS (SELECT source, tokens, weight, floor(weight * n + 1e-6)::BIGINT AS quota,
             greatest(1, ceil(tokens / greatest({BLOCK_TOKENS}, ceil(n / {MOST_BLOCKS}))))::BIGINT AS blocks FROM w),
r AS (SELECT source, weight, quota // tokens AS passes, quota % tokens AS left_, blocks FROM q
      UNION ALL SELECT source, 0.0, 1, 0, 1 FROM tot WHERE tokens = 0),
b AS (SELECT d.*, weight, passes, left_, ('0x' || substr(md5('17:' || doc_id), 1, 13))::BIGINT % blocks AS block FROM d JOIN r USING (source)),
bt AS (SELECT source, block, sum(n_tokens) AS block_tokens, any_value(left_) AS left_ FROM b GROUP BY ALL),
room AS (SELECT source, block, block_tokens, left_ - sum(block_tokens) OVER (
             PARTITION BY source ORDER BY ('0x' || substr(md5('18:' || source || ':' || block), 1, 13))::BIGINT, block
             ROWS UNBOUNDED PRECEDING) + block_tokens AS room FROM bt),
c AS (SELECT b.*, room, block_tokens, sum(n_tokens) OVER (
             PARTITION BY source, block ORDER BY ('0x' || substr(md5('19:' || doc_id), 1, 13))::BIGINT, doc_id
             ROWS UNBOUNDED PRECEDING) AS upto FROM b JOIN room USING (source, block))
SELECT doc_id, source, n_tokens, round(weight, 9) AS weight,
       (passes + CASE WHEN n_tokens = 0 THEN CASE WHEN passes = 0 THEN 1 ELSE 0 END
                      WHEN room <= 0 THEN 0 WHEN block_tokens <= room OR upto <= room THEN 1 ELSE 0 END)::BIGINT AS n_copies,
       block::BIGINT AS block
FROM c
"""

QUERIES = {"op3_mixing": op3_mixing}
ORACLES = {"op3_mixing": SQL}
