"""Batches of questions end to end: redaction, retrieval, confidence, and refusal or the chunks to answer from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.config import DEFAULTS, Settings
from corpusmill.functions.redaction import mask
from corpusmill.operators.confidence import refusals
from corpusmill.operators.encode import Encoder, embed, hashing_encoder
from corpusmill.operators.search import hybrid_search
from corpusmill.session import cut


def ask_batch(chunks: DataFrame, documents: DataFrame, questions: DataFrame, encoder: Encoder = hashing_encoder, settings: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """(hits of the questions to be answered, refusals of the rest) for ``questions`` (question_id, text).

    Identifiers are masked before anything else sees a question; questions without hits are refused.
    """
    own = questions.select("question_id", mask(F.col("text")).alias("text")).dropDuplicates(["question_id"])
    asked = cut(embed(own, out="vector", encoder=encoder))
    hits = cut(hybrid_search(chunks, documents, asked, settings.dense_k, settings.sparse_k, settings.rrf_k, settings.top_k))
    refused = refusals(own, hits, settings.confidence_threshold)
    return hits.join(refused.select("question_id"), "question_id", "left_anti"), refused
