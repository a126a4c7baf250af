"""python -m rupaka nouns|verbs|sentences --lexicon FILE [WORD OR SENTENCE ...]; without any, each line of standard input is answered as it comes.

python -m rupaka evaluate-nouns|evaluate-verbs FOLDER --lexicon FILE [--lexicon2 FILE] [--out FOLDER] [--sample N]: a treebank folder's report.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from rupaka.operators import disambiguate, nouns, verbs
from rupaka.plans import evaluation
from rupaka.sources.lexicons import load_lexicon


def shown(df: DataFrame) -> None:
    for r in df.toLocalIterator():
        print(*r)


def answered(spark: SparkSession, what: str, lexicon: DataFrame | None, lines: list[str]) -> None:
    if what == "sentences":
        df = spark.createDataFrame(list(enumerate(lines)), "sent_id long, text string")
        return shown(disambiguate.shown(disambiguate.disambiguate(df, lexicon)).orderBy("sent_id", "pos"))
    df = spark.createDataFrame([(x,) for x in lines], "word string")
    shown((nouns.shown(nouns.analyze_nouns(df, lexicon)) if what == "nouns" else verbs.shown(verbs.analyze_verbs(df))).orderBy("surface", "ord"))


def evaluated(spark: SparkSession, what: str, folder: str, lexicon: str | None, second: str | None, out: str | None, n: int) -> None:
    if what == "evaluate-verbs":
        reports, compared = [evaluation.evaluate_verbs(spark, folder)], None
    else:
        one, two, compared = evaluation.evaluate_nouns(spark, folder, lexicon, second)
        reports = [one] if two is None else [one, two]
    for k, r in enumerate(reports, 1):
        shown(r.skipped)
        shown(r.metrics.orderBy("dim", "value"))
        shown(r.failures.orderBy("failure_type"))
        stratum = "paradigm" if what == "evaluate-nouns" else "vtype"
        shown(r.sample(n, stratum, stratum))
        if out:
            r.write(f"{out}/{k}", n)
    if compared is not None:
        shown(compared)


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="rupaka", description=__doc__)
    p.add_argument("what", choices=("nouns", "verbs", "sentences", "evaluate-nouns", "evaluate-verbs"))
    p.add_argument("--lexicon", help="tab-separated table with word and paradigm_class")
    p.add_argument("--lexicon2", help="a second lexicon to compare with")
    p.add_argument("--out", help="folder for error lists and metrics")
    p.add_argument("--sample", type=int, default=20, help="errors to show")
    p.add_argument("text", nargs="*")
    a = p.parse_intermixed_args(args)
    if "verbs" not in a.what and not a.lexicon:
        p.error("nouns and sentences need a lexicon")
    spark = SparkSession.builder.appName("rupaka").getOrCreate()
    if a.what.startswith("evaluate"):
        return evaluated(spark, a.what, a.text[0], a.lexicon, a.lexicon2, a.out, a.sample)
    lexicon = load_lexicon(spark, a.lexicon).cache() if a.lexicon else None
    if a.text:
        return answered(spark, a.what, lexicon, a.text)
    for line in sys.stdin:
        answered(spark, a.what, lexicon, [line.rstrip("\n")])


if __name__ == "__main__":
    main()
