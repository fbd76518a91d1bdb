"""Mixing sources to target weights (problem 9).

The mix's size is ``total`` tokens if that is given: a source whose cap lets it give less than its share gives all that it
may, and the others share the rest by their targets. Else it is the largest size at which every source with documents
and a positive target can give its (renormalised) share without being repeated more than its cap. A source that must give ``f`` times its tokens gives every document
``floor(f)`` times, and one more time to a sample of them with inclusion probability ``f - floor(f)``.

The sample is balanced by the cube method: the flight phase moves the inclusion probabilities of three documents at a
time along the null space of two constraints (tokens and documents), so both totals stay while probabilities reach 0
or 1. It runs in blocks of at most about ``BLOCK`` documents of a source, spread by a hash of the document; the at
most two undecided documents of each block meet again in the next round, until one block a source remains, whose
landing phase rounds them to the nearest token total. Sources with a third of all rows thus spread over all tasks.

Defined cases: sources match after trimming and lower-casing; sources without target or with share 0 aren't used;
targets without documents reach 0 and are reported; null source, null and empty texts aren't used; repeated targets:
the largest share and cap; repeated rows of a document count once; nothing to mix gives an empty mix and a report.
"""

from __future__ import annotations

import random
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.arrow import columns, map_columns
from corpusmill.llm.encoding import VOCABULARY, count_tokens
from corpusmill.session import cut

BLOCK = 2_000
SEED = 20_260_101


def source_key(source: Column) -> Column:
    return F.lower(F.trim(source))


def cube_flight(tokens: list[int], chances: list[float], seed: int) -> list[float]:
    """Inclusion probabilities after the flight phase: at most two stay strictly between 0 and 1, while the
    expected totals of documents and of tokens are as before."""
    rng = random.Random(seed)
    p = list(chances)
    order = [i for i in range(len(p)) if 1e-9 < p[i] < 1 - 1e-9]
    rng.shuffle(order)
    held: list[int] = []
    for i in order:
        held.append(i)
        if len(held) < 3:
            continue
        a, b, c = held
        # null space of ((1, 1, 1), (x_a, x_b, x_c))
        u = (tokens[c] - tokens[b], tokens[a] - tokens[c], tokens[b] - tokens[a])
        if not any(u):
            u = (1, -1, 0)
        up = min((1 - p[k]) / v if v > 0 else p[k] / -v for k, v in zip(held, u) if v)
        down = min(p[k] / v if v > 0 else (1 - p[k]) / -v for k, v in zip(held, u) if v)
        step = up if rng.random() * (up + down) < down else -down
        for k, v in zip(held, u):
            p[k] += step * v
        held = [k for k in held if 1e-9 < p[k] < 1 - 1e-9]
    return [0.0 if x <= 1e-9 else 1.0 if x >= 1 - 1e-9 else x for x in p]


def cube_landing(tokens: list[int], chances: list[float], goal: float | None = None) -> list[float]:
    """The few undecided rounded so that the tokens come nearest to what was expected.

    Tokens come before documents: what rounding leaves is mended by exchanging a document that is in for one that is out,
    or by moving one, as long as that brings the tokens nearer to ``goal``."""
    goal = sum(t * x for t, x in zip(tokens, chances)) if goal is None else goal
    open_ = [i for i, x in enumerate(chances) if 0 < x < 1]
    out = list(chances)
    sure = sum(t for t, x in zip(tokens, chances) if x == 1.0)
    best = min(range(1 << len(open_)), key=lambda m: (abs(sure + sum(tokens[i] for k, i in enumerate(open_) if m >> k & 1) - goal), m))
    for k, i in enumerate(open_):
        out[i] = float(best >> k & 1)
    gap = goal - sum(t for t, x in zip(tokens, out) if x == 1.0)
    while abs(gap) >= 1:
        inside, outside = (sorted({tokens[i]: i for i in range(len(tokens)) if out[i] == y}.items()) for y in (1.0, 0.0))
        moves = [(abs(gap - t), t, None, i) for t, i in outside] + [(abs(gap + t), -t, i, None) for t, i in inside]
        sizes = [t for t, _ in outside]
        for t, i in inside:
            at = bisect_left(sizes, t + gap)
            moves += [(abs(gap - (outside[k][0] - t)), outside[k][0] - t, i, outside[k][1]) for k in (at - 1, at) if 0 <= k < len(sizes)]
        least = min(moves, default=(abs(gap), 0, None, None), key=lambda m: (m[0], m[1]))
        if least[0] >= abs(gap):
            break
        gap -= least[1]
        for i, y in ((least[2], 0.0), (least[3], 1.0)):
            if i is not None:
                out[i] = y
    return out


def _round(df: DataFrame, block: int, number: int, last: bool, seed: int) -> DataFrame:
    """One round of flights over blocks; ``df``: _source, _doc, _tokens, _p, _blocks."""
    at = F.pmod(F.xxhash64("_doc", F.lit(number + seed)), F.col("_blocks"))
    grouped = df.groupBy("_source", at.alias("_block")).agg(F.sort_array(F.collect_list(F.struct("_doc", "_tokens", "_p"))).alias("rows"))

    def fly(sources: list, blocks: list, groups: list) -> tuple:
        rows = []
        for s, k, g in zip(sources, blocks, groups):
            tokens = [r["_tokens"] for r in g]
            p = cube_flight(tokens, [r["_p"] for r in g], seed + 7919 * number + k)
            p = cube_landing(tokens, p) if last else p
            rows += [(s, r["_doc"], r["_tokens"], x) for r, x in zip(g, p)]
        return columns(rows, 4)

    kind = {f.name: f.dataType.simpleString() for f in df.schema}["_doc"]
    return map_columns(grouped, fly, f"_source string, _doc {kind}, _tokens bigint, _p double")


def balanced_sample(df: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """_source, _doc, _tokens, _p of ``df`` with every _p decided to 0 or 1, balanced on tokens and documents by source."""
    open_, decided, number = df, None, 0
    while True:
        sizes = open_.groupBy("_source").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("_blocks"))
        most = sizes.agg(F.max("_blocks")).first()[0]
        last = most is None or most <= 1
        flown = cut(_round(open_.join(sizes, "_source"), block, number, last, seed))
        done = flown.where("_p in (0.0, 1.0)")
        decided = done if decided is None else decided.unionByName(done)
        if last:
            return decided
        open_, number = flown.where("_p not in (0.0, 1.0)"), number + 1


def allotted(shares: dict[str, float], most: dict[str, float], total: float) -> dict[str, float]:
    """Tokens by source: by share, nobody above ``most``; what capped sources leave goes to the others by their shares."""
    given, open_ = {}, dict(shares)
    while open_:
        rest, weight = total - sum(given.values()), sum(open_.values())
        capped = {s: most[s] for s, x in open_.items() if rest * x / weight > most[s]}
        if not capped:
            return given | {s: rest * x / weight for s, x in open_.items()}
        given |= capped
        open_ = {s: x for s, x in open_.items() if s not in capped}
    return given


def mix_plan(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, total: int | None = None, doc: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """(documents with tokens, one row a target with its factor); the first is cut."""
    own = documents.select(F.col(doc).alias("_doc"), source_key(F.col(source)).alias("_source"), F.col(text).alias("_text")).where("_doc is not null and _text <> ''")
    goal = targets.select(source_key(F.col("source")).alias("_source"), "target_share", "max_repeats").where("_source is not null").groupBy("_source")
    goal = goal.agg(F.greatest(F.coalesce(F.max("target_share"), F.lit(0.0)), F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce(F.max("max_repeats"), F.lit(1)), F.lit(0)).alias("max_repeats"))
    counted = count_tokens(own, "_text", "_tokens", vocabulary).groupBy("_doc").agg(F.max_by("_source", "_tokens").alias("_source"), F.max("_tokens").alias("_tokens"))
    counted = cut(counted.join(goal.where("target_share > 0").select("_source"), "_source", "left_semi").where("_tokens > 0"))
    have = counted.groupBy("_source").agg(F.sum("_tokens").alias("tokens"), F.count("*").alias("documents"))
    plan = goal.join(have, "_source", "left")
    usable = (F.col("target_share") > 0) & (F.coalesce("tokens", F.lit(0)) > 0) & (F.col("max_repeats") > 0)
    every = Window.partitionBy()  # one row a source of the targets, a table that doesn't grow
    plan = plan.withColumn("share", F.when(usable, F.col("target_share") / F.sum(F.when(usable, F.col("target_share"))).over(every)))
    plan = plan.withColumn("total", F.min(F.col("max_repeats") * F.col("tokens") / F.col("share")).over(every))
    if total is None:
        return counted, cut(plan.withColumn("factor", F.col("share") * F.col("total") / F.col("tokens")))
    rows = plan.where("share is not null").select("_source", "share", "tokens", (F.col("max_repeats") * F.col("tokens")).alias("most")).collect()  # one row a target
    given = allotted({r[0]: r[1] for r in rows}, {r[0]: float(r[3]) for r in rows}, float(total))
    factors = documents.sparkSession.createDataFrame([(r[0], given[r[0]] / r[2]) for r in rows], "_source string, factor double")
    return counted, cut(plan.join(factors, "_source", "left"))


def mixed(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, block: int = BLOCK, seed: int = SEED, total: int | None = None, **names: str) -> tuple[DataFrame, DataFrame]:
    """(mix: doc_id, source, n_tokens, copies; report: one row a target source, with the relative error of its share)."""
    counted, plan = mix_plan(documents, targets, vocabulary, total, **names)
    whole = F.floor(F.col("factor") + 1e-9)
    placed = counted.join(plan.where("factor is not null").select("_source", whole.alias("_whole"), F.greatest(F.col("factor") - whole, F.lit(0.0)).alias("_p")), "_source")
    drawn = balanced_sample(placed.select("_source", "_doc", "_tokens", "_p"), block, seed)
    mix = drawn.join(plan.select("_source", whole.alias("_whole")), "_source").withColumn("copies", (F.col("_whole") + F.col("_p")).cast("int"))
    mix = mix.where("copies > 0").select(F.col("_doc").alias("doc_id"), F.col("_source").alias("source"), F.col("_tokens").alias("n_tokens"), "copies")
    got = mix.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"), F.sum("copies").alias("mixed_documents"), F.max("copies").alias("most_repeats"))
    every = Window.partitionBy()
    zero = lambda c: F.coalesce(c, F.lit(0))
    report = plan.withColumnRenamed("_source", "source").join(got, "source", "left")
    report = report.select(
        "source", "target_share", F.coalesce("share", F.lit(0.0)).alias("share_sought"),
        (zero(F.col("mixed_tokens")) / F.sum("mixed_tokens").over(every)).alias("share_reached"),
        ((zero(F.col("mixed_tokens")) / F.sum("mixed_tokens").over(every)) / F.col("share") - 1).alias("relative_error"), "max_repeats", zero(F.col("most_repeats")).alias("most_repeats"),
        (zero(F.col("mixed_tokens")) / F.col("tokens")).alias("mean_repeats"), zero(F.col("documents")).alias("documents"), zero(F.col("tokens")).alias("tokens"),
        zero(F.col("mixed_documents")).alias("mixed_documents"), zero(F.col("mixed_tokens")).alias("mixed_tokens"),
    )
    return mix, report
