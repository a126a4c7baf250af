"""The public names in one place."""

from rupaka.functions import normal
from rupaka.operators.bigram import bigram_counts, bigram_model, scored as scored_bigrams, scores as bigram_scores, sparse_model
from rupaka.operators.disambiguate import disambiguate, disambiguate_sentence, resolved
from rupaka.operators.evaluate import compared, evaluated_nouns, evaluated_verbs, failures, rollup, stratified_sample
from rupaka.operators.nouns import analyze_nouns
from rupaka.operators.verbs import analyze_verbs, detect_aux
from rupaka.operators.gender import predict as predict_gender
from rupaka.operators.scan import scanned
from rupaka.operators.terms import Terms, marked, marked_by_join
from rupaka.plans.evaluation import Report, evaluate_nouns, evaluate_verbs, nouns_report, verbs_report
from rupaka.plans.predictor import predicted_lexicon
from rupaka.sources.lexicons import keyed_lexicon, load_lexicon, ordered_lines
from rupaka.sources.rules import irregular_verbs, load_flag_map, load_irregular, load_suffix_rules, noun_rules, verb_rules
from rupaka.sources.sinks import complete_lexicon, metric_report, noun_error_rows, read_routes, reformatted_rules, verb_error_rows, write_lines, write_routes, write_tiers, write_tsv
from rupaka.sources.treebank import class_sequences, gold_nouns, gold_verbs, treebank_lines
from rupaka.streaming import sentences as streaming

__all__ = [
    "Report", "Terms", "analyze_nouns", "analyze_verbs", "bigram_counts", "bigram_model", "bigram_scores",
    "class_sequences", "compared", "complete_lexicon", "detect_aux", "disambiguate", "disambiguate_sentence",
    "evaluate_nouns", "evaluate_verbs", "evaluated_nouns", "evaluated_verbs", "failures", "gold_nouns",
    "gold_verbs", "irregular_verbs", "keyed_lexicon", "load_flag_map", "load_irregular", "load_lexicon",
    "load_suffix_rules", "marked", "marked_by_join", "metric_report", "normal", "noun_error_rows",
    "noun_rules", "nouns_report", "ordered_lines", "predict_gender", "predicted_lexicon", "read_routes",
    "reformatted_rules", "resolved", "rollup", "scanned", "scored_bigrams", "sparse_model",
    "stratified_sample", "streaming", "treebank_lines", "verb_error_rows", "verb_rules", "verbs_report",
    "write_lines", "write_routes", "write_tiers", "write_tsv",
]
