"""Confidence of a result list, and the refusal when it is too low."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.routing import CONTACTS, LEAD_IN, link_of, office_of, refusal_message, topic_of

#: Weights of similarity, gap and support, the gap and support that count fully. (Fixed values.)
WEIGHTS, FULL_GAP, FULL_SUPPORT = (0.55, 0.25, 0.20), 0.15, 3


def confidence(questions: DataFrame, hits: DataFrame, threshold: float = 0.35, clamp_gap: bool = False) -> DataFrame:
    """question_id, top1_similarity, top1_top5_gap, chunks_above_threshold, score, should_refuse of every question.

    ``hits``: question_id, rank (1 is best), dense_distance (null for hits of the full-text leg only: similarity 0).
    Questions without hits score 0 and are refused. The gap may be negative (the list is ordered by fused score);
    ``clamp_gap`` keeps it at 0.
    """
    similarity = F.greatest(F.lit(0.0), F.lit(1.0) - F.coalesce("dense_distance", F.lit(1.0)))
    sized = hits.groupBy("question_id").agg(F.max("rank").alias("_n"), F.max(F.when(F.col("rank") == 1, similarity)).alias("_top"), F.count_if(similarity >= threshold).alias("_above"),
                                            F.collect_set(F.when(F.col("rank") <= 5, F.struct("rank", similarity.alias("s")))).alias("_first"))
    own = questions.select("question_id").distinct().join(sized, "question_id", "left")
    top = F.coalesce("_top", F.lit(0.0))
    gap = top - F.coalesce(F.array_max(F.filter("_first", lambda x: x["rank"] == F.least("_n", F.lit(5))))["s"], F.lit(0.0))
    gap = F.greatest(gap, F.lit(0.0)) if clamp_gap else gap
    above = F.coalesce("_above", F.lit(0))
    score = WEIGHTS[0] * top + WEIGHTS[1] * F.least(gap / FULL_GAP, F.lit(1.0)) + WEIGHTS[2] * F.least(above / FULL_SUPPORT, F.lit(1.0))
    score = F.when(F.col("_n").isNull(), 0.0).otherwise(F.round(score, 6))
    return own.select("question_id", F.round(top, 6).alias("top1_similarity"), F.round(F.when(F.col("_n").isNull(), 0.0).otherwise(gap), 6).alias("top1_top5_gap"),
                      above.alias("chunks_above_threshold"), score.alias("score"), (F.col("_n").isNull() | (score < threshold)).alias("should_refuse"))


def refusals(questions: DataFrame, hits: DataFrame, threshold: float = 0.35, contacts: dict[str, tuple[str, str]] = CONTACTS, lead_in: str = LEAD_IN) -> DataFrame:
    """question_id, topic, office_name, office_url, message, score of the questions to be refused; the rest goes on."""
    rated = confidence(questions, hits, threshold).where("should_refuse").select("question_id", "score")
    own = questions.dropDuplicates(["question_id"]).join(rated, "question_id")
    topic = topic_of(F.col("text"))
    return own.select("question_id", topic.alias("topic"), office_of(topic, contacts).alias("office_name"), link_of(topic, contacts).alias("office_url"), refusal_message(topic, contacts, lead_in).alias("message"), "score")
