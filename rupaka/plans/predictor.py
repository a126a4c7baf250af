"""From classified and unclassified words to predictions, lists, the completed lexicon and a report of the model, in one call."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from rupaka.operators import gender
from rupaka.sources import lexicons, sinks


class Predicted(NamedTuple):
    """model; predictions: word, p_m, gender, probability, paradigm_class, tier, originals, clash; lexicon: as complete_lexicon(); accuracy (of each fold), spread, report (of the last fold) and endings are null without folds."""

    model: PipelineModel
    predictions: DataFrame
    lexicon: DataFrame
    accuracy: DataFrame | None
    spread: DataFrame | None
    report: DataFrame | None
    endings: DataFrame | None


def classed(words: DataFrame) -> DataFrame:
    """word, paradigm_class, confidence of what lexicon building gives, which names the class ``paradigm`` and needn't have a confidence."""
    paradigm = F.col("paradigm_class" if "paradigm_class" in words.columns else "paradigm")
    confidence = F.col("confidence") if "confidence" in words.columns else F.lit("certain")
    return words.select("word", paradigm.alias("paradigm_class"), confidence.alias("confidence"))


def predicted_lexicon(classified: DataFrame, merged: DataFrame, folder: str | None = None, folds: int = 5, most: int = 15) -> Predicted:
    """Fits the gender predictor on the classified words, predicts the consonant-final words of ``merged`` that have no class, and completes the lexicon.

    classified, merged: word and paradigm_class (or paradigm). Only predictions that are high or
    medium enter the lexicon. folder: where the three lists of predictions go. folds: of the
    cross-validation; 0 leaves it out.
    """
    known, others = classed(classified), classed(merged)
    labelled = lexicons.training_words(known).distinct()
    model = gender.fit(labelled)
    targets = lexicons.excluded_words(others, known)
    said = gender.predict(model, targets).join(targets, "word")
    if folder:
        sinks.write_routes(said, folder)
    sure = said.filter(F.col("tier").isin("high", "medium")).withColumn("confidence", F.concat(F.lit("predicted_"), "tier"))
    lexicon = sinks.complete_lexicon(known, sure.select("word", "paradigm_class", "confidence", "probability"))
    if not folds:
        return Predicted(model, said, lexicon, None, None, None, None)
    accuracy, confusion = gender.cross_validated(labelled, folds)
    return Predicted(model, said, lexicon, accuracy, gender.spread(accuracy), gender.report(confusion), gender.top_features(model, most))
