"""One ranking from several differently-scaled scores (problem 6).

Leximin ordering: within a question each score becomes a percentile (its rank among the hits that have the score, as a
share of all hits of the question), a missing score counts as the lowest, each hit's percentiles are sorted ascending and
the vectors compared lexicographically from the largest: the best worst score wins, so no range can dominate and no weak
score is masked.

Questions of up to ``ROWS_AT_ONCE`` rows are ranked by windows that share one exchange. A larger question is ranked
without a window over it: its rows are range-partitioned in their final order, ties by id, so that many tasks share it;
counts of the partitions give the offsets. Both ways give the same ranks.

Defined cases: null and NaN scores are missing; ties share a rank; repeated rows are one hit; a null question is a
group of its own; equal vectors are ordered by id; an empty table gives an empty ranking.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.session import cut, small_side

ROWS_AT_ONCE = 100_000
SCORES = (("dense_distance", False), ("sparse_score", True), ("rrf_score", True))


def _before(df: DataFrame, order: list[str], weight: Column) -> DataFrame:
    """``df`` with _before: the sum of ``weight`` over the rows of its _g that come first in ``order`` (ascending, unique
    inside a group), however large a group is."""
    placed = cut(df.repartitionByRange("_g", *order).withColumn("_part", F.spark_partition_id()))
    parts = placed.groupBy("_g", "_part").agg(F.sum(weight).alias("_sum"))
    earlier = parts.select(F.col("_g").alias("_pg"), F.col("_part").alias("_pp"), (F.sum("_sum").over(Window.partitionBy("_g").orderBy("_part")) - F.col("_sum")).alias("_offset"))
    inside = F.sum(weight).over(Window.partitionBy("_g", "_part").orderBy(*order)) - weight
    joined = placed.withColumn("_inside", inside).join(earlier, F.col("_g").eqNullSafe(F.col("_pg")) & (F.col("_part") == F.col("_pp")))
    return joined.withColumn("_before", F.col("_offset") + F.col("_inside")).drop("_pg", "_pp", "_part", "_offset", "_inside")


def _vector(df: DataFrame, n: int) -> DataFrame:
    """``df`` with _v, the percentiles as integers out of _hits (so that they compare exactly; 0: missing), ascending,
    and their negatives to order by."""
    df = df.withColumn("_v", F.array_sort(F.array(*[F.coalesce(F.col("_hits") - F.col(f"_r{k}") + 1, F.lit(0)) for k in range(n)])))
    return df.withColumns({f"_o{k}": -F.col("_v")[k] for k in range(n)})


def _ranked_at_once(own: DataFrame, n: int) -> DataFrame:
    by = Window.partitionBy("_g")
    ranked = own.withColumns({f"_r{k}": F.when(F.col(f"_s{k}").isNotNull(), F.rank().over(by.orderBy(F.col(f"_s{k}").desc_nulls_last()))) for k in range(n)})
    ranked = _vector(ranked.withColumn("_hits", F.count("*").over(by)), n)
    return ranked.withColumn("final_rank", F.row_number().over(by.orderBy(*[f"_o{k}" for k in range(n)], "_i", *[f"_s{k}" for k in range(n)])).cast("bigint"))


def _ranked_in_parts(own: DataFrame, n: int) -> DataFrame:
    own = cut(own)
    out = own
    for k in range(n):
        values = own.where(f"_s{k} is not null").groupBy("_g", f"_s{k}").agg(F.count("*").alias("_n")).withColumn("_low", -F.col(f"_s{k}"))
        ranks = _before(values, ["_low"], F.col("_n")).select(F.col("_g").alias("_rg"), F.col(f"_s{k}").alias("_rs"), (F.col("_before") + 1).alias(f"_r{k}"))
        out = out.join(ranks, F.col("_g").eqNullSafe(F.col("_rg")) & (F.col(f"_s{k}") == F.col("_rs")), "left").drop("_rg", "_rs")
    sizes = own.groupBy("_g").agg(F.count("*").alias("_hits")).withColumnRenamed("_g", "_rg")
    out = _vector(out.join(sizes, F.col("_g").eqNullSafe(F.col("_rg"))).drop("_rg"), n)
    order = [*[f"_o{k}" for k in range(n)], "_i", *[f"_s{k}" for k in range(n)]]
    return _before(out, order, F.lit(1)).withColumn("final_rank", (F.col("_before") + 1).cast("bigint"))


def leximin_ranking(
    hits: DataFrame, group: str = "question_id", item: str = "chunk_id", scores: tuple[tuple[str, bool], ...] = SCORES, rows_at_once: int = ROWS_AT_ONCE
) -> DataFrame:
    """group, item, each score's rank_<score> (null where missing), percentiles (sorted ascending) and final_rank.

    ``scores`` are (column, whether higher is better); a hit is one distinct (group, item, scores).
    """
    clean = lambda c, up: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double") * (1 if up else -1))
    own = hits.select(F.col(group).alias("_g"), F.col(item).alias("_i"), *[clean(c, up).alias(f"_s{k}") for k, (c, up) in enumerate(scores)])
    n = len(scores)
    large = cut(own.groupBy("_g").agg(F.count("*").alias("_n")).where(F.col("_n") > rows_at_once).select(F.col("_g").alias("_big")))
    if large.isEmpty():
        ranked = _ranked_at_once(own.distinct(), n)
    else:
        big, same = small_side(large), F.col("_g").eqNullSafe(F.col("_big"))
        shown = ["_g", "_i", *[f"_r{k}" for k in range(n)], "_v", "_hits", "final_rank"]
        few, many = own.join(big, same, "left_anti").distinct(), own.join(big, same, "left_semi").distinct()
        ranked = _ranked_at_once(few, n).select(shown).unionByName(_ranked_in_parts(many, n).select(shown))
    percentiles = F.transform("_v", lambda x: x / F.col("_hits"))
    ranks = [F.col(f"_r{k}").cast("bigint").alias(f"rank_{c}") for k, (c, _) in enumerate(scores)]
    return ranked.select(F.col("_g").alias(group), F.col("_i").alias(item), *ranks, percentiles.alias("percentiles"), "final_rank")


def undisputed_hits(hits: DataFrame, best: int = 3, rival: int = 6) -> DataFrame:
    """question_id, chunk_id of hits among the best ``best`` on all three scores, where no other hit of the question is
    among the best ``rival`` on both the dense and the sparse score; taken from the ranking."""
    ranked = leximin_ranking(hits)
    rivals = (F.col("rank_dense_distance") <= rival) & (F.col("rank_sparse_score") <= rival)
    per = ranked.where(rivals).groupBy("question_id").agg(
        F.count("*").alias("n"), F.first("chunk_id").alias("chunk_id"), F.max(F.greatest("rank_dense_distance", "rank_sparse_score", "rank_rrf_score")).alias("worst"),
        F.max(F.col("rank_rrf_score").isNull()).alias("missing"), F.min("final_rank").alias("final_rank"),
    )
    return per.where((F.col("n") == 1) & ~F.col("missing") & (F.col("worst") <= best) & (F.col("final_rank") == 1)).select("question_id", "chunk_id")
