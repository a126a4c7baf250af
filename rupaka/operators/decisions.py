"""Ordered decision lists over the tags around a token: the first rule that matches decides."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F


def decide(tokens: DataFrame, rules: list[tuple[dict[int, str], str]], default: str, tag: str = "tag") -> DataFrame:
    """Adds decision and rule_ord to (sent_id, pos, tag). rules: ({offset: tag that must stand there}, decision), in order; the default has the last ordinal.

    A rule list is code-sized: it becomes one CASE over the tags at the offsets it uses.
    """
    w = Window.partitionBy("sent_id").orderBy("pos")
    offsets = sorted({k for conditions, _ in rules for k in conditions})
    name = lambda k: f"_at{k}"
    df = tokens.select("*", *((F.lead(tag, k) if k > 0 else F.lag(tag, -k) if k < 0 else F.col(tag)).over(w).alias(name(k)) if k else F.col(tag).alias(name(0)) for k in offsets))
    tests = [reduce(lambda a, b: a & b, [F.col(name(k)).eqNullSafe(F.lit(v)) for k, v in c.items()], F.lit(True)) for c, _ in rules]
    at = reduce(lambda acc, k: acc.when(tests[k], F.lit(k)), range(1, len(rules)), F.when(tests[0], F.lit(0))).otherwise(len(rules)) if rules else F.lit(0)
    out = df.withColumn("rule_ord", at)
    said = F.array(*(F.lit(d) for _, d in rules), F.lit(default))
    return out.withColumn("decision", F.get(said, F.col("rule_ord"))).drop(*map(name, offsets))
