"""Evaluation from treebank lines to reports: gold tokens, analyses, matches, rollups, error lists."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from rupaka.operators import evaluate as ev
from rupaka.operators.nouns import analyze_nouns
from rupaka.operators.verbs import analyze_verbs
from rupaka.sources import sinks
from rupaka.sources.lexicons import load_lexicon
from rupaka.sources.treebank import gold_nouns, gold_verbs, treebank_lines


@dataclass
class Report:
    """tokens: evaluated gold tokens; skipped: how many had no lemma; metrics: rollups with shares; failures: counts by type; errors: the flat error list; distribution: gold tokens by tag (verbs)."""

    tokens: DataFrame
    skipped: DataFrame
    metrics: DataFrame
    failures: DataFrame
    errors: DataFrame
    distribution: DataFrame | None = None

    def sample(self, n: int, stratum: str, label: str) -> DataFrame:
        """Readable lines of up to n errors, each stratum by its share."""
        failed = self.tokens.filter("failure_type is not null")
        return sinks.error_sample(ev.stratified_sample(failed, stratum, n, "file", "line_no"), F.col(label))

    def write(self, folder: str, n: int = 20) -> None:
        """The error list, the metrics and a sample of errors below ``folder``."""
        sinks.write_tsv(self.errors, f"{folder}/errors", "file", "line_no")
        sinks.write_tsv(self.metrics, f"{folder}/metrics", "dim", "value")
        sinks.write_tsv(self.failures, f"{folder}/failures", "failure_type")
        stratum = "paradigm" if "paradigm" in self.tokens.columns else "vtype"
        sinks.write_lines(self.sample(n, stratum, stratum), f"{folder}/sample")


def nouns_report(lines: DataFrame, lexicon: DataFrame) -> Report:
    """The report on the nouns of treebank lines (file, line_no, line) under a lexicon (norm, display, paradigm, confidence)."""
    gold, skipped = gold_nouns(lines)
    tokens = ev.evaluated_nouns(gold, analyze_nouns(gold, lexicon, word="surface"), lexicon)
    metrics = sinks.metric_report(ev.rollup(tokens, "paradigm", "confidence"))
    return Report(tokens, skipped, metrics, ev.failures(tokens), sinks.noun_error_rows(tokens.filter("failure_type is not null")))


def verbs_report(lines: DataFrame, **rules) -> Report:
    """The report on the verbs of treebank lines; rules: rule tables of analyze_verbs()."""
    gold, skipped = gold_verbs(lines)
    tokens = ev.evaluated_verbs(gold, analyze_verbs(gold, word="surface", **({"with_aux": False} | rules)))
    metrics = sinks.metric_report(ev.rollup(tokens, "vtype", "confidence", "cpos"))
    return Report(tokens, skipped, metrics, ev.failures(tokens), sinks.verb_error_rows(tokens.filter("failure_type is not null")), ev.distribution(tokens, "cpos"))


def evaluate_nouns(spark: SparkSession, folder: str, lexicon: str, second: str | None = None) -> tuple[Report, Report | None, DataFrame | None]:
    """The report on a treebank folder under a lexicon file, the one under a second lexicon file, and both compared (metric, a, b, delta)."""
    lines = treebank_lines(spark, folder)
    one = nouns_report(lines, load_lexicon(spark, lexicon))
    if second is None:
        return one, None, None
    two = nouns_report(lines, load_lexicon(spark, second))
    return one, two, ev.compared(ev.rollup(one.tokens), ev.rollup(two.tokens))


def evaluate_verbs(spark: SparkSession, folder: str, **rules) -> Report:
    """The report on the verbs of a treebank folder."""
    return verbs_report(treebank_lines(spark, folder), **rules)
