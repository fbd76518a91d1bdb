"""Batches of questions against all chunks: exact dense top-k, full-text top-k, reciprocal-rank fusion.

Dense: the questions' vectors, at most ``BLOCK`` at a time, go to the tasks, each Arrow batch of chunk vectors is
matrix products, and only the best k of a task leave it; the final ranking is a window over k rows a task. With an
index (``train_cells``, ``with_cells``) a question is compared only with the chunks of its nearest cells, whose distances
are exact; ``probes_for`` finds how many cells a recall takes. Without one the search is exact.

Sparse: a block of questions goes to the tasks too and the texts are read once; only a task's best k leave it. Where
postings (token, chunk, positions) are kept as a table (``postings``) they are joined to the questions' tokens instead,
and no pair without a common token is built. Ties are ordered by chunk id; a chunk that stands there twice counts once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.arrow import columns, map_columns
from corpusmill.functions.fulltext import analyze, cover_rank
from corpusmill.session import cut, small_side, spread

BLOCK = 20_000
#: The questions' lexemes are broadcast to kept postings up to this many (about 30 MB), and shuffled beyond.
MAX_TOKENS = 500_000


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine of two vectors, in double; null where a vector is null or zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, F.lit(1.0) - dot(a, b) / norm)


def _kth(distance: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """A bound that the best k distinct ids of each row keep."""
    repeats = len(ids) - len(np.unique(ids))
    k += repeats
    return np.partition(distance, k - 1, axis=1)[:, k - 1] if distance.shape[1] > k else np.full(len(distance), np.inf)


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1).astype(np.float64)


def train_cells(vectors: DataFrame, key: str, vector: str, cells: int = 64, sample: int = 20_000, rounds: int = 10) -> np.ndarray:
    """Unit centroids of an index, by k-means over a bounded sample: the ``sample`` vectors with the least hash of the key."""
    own = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull())
    rows = own.select(F.col(vector).alias("v")).orderBy(F.xxhash64(key), key).limit(sample).collect()
    v = np.array([r.v for r in rows], np.float64)
    size = np.linalg.norm(v, axis=1) if len(v) else np.zeros(0)
    v = v[size > 0] / size[size > 0, None] if len(v) else np.zeros((0, 1))
    if not len(v):
        return v
    centres = v[np.random.RandomState(1).permutation(len(v))[: min(cells, len(v))]]
    for _ in range(rounds):
        nearest = (v @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, v)
        length = np.linalg.norm(sums, axis=1)
        centres = np.where(length[:, None] > 0, sums / np.where(length > 0, length, 1)[:, None], centres)
    return centres


def with_cells(chunks: DataFrame, centres: np.ndarray) -> DataFrame:
    """chunk_id, embedding, cell of every chunk with a vector; written partitioned by cell it is the stored index."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = _matrix(b.column(1), b.num_rows)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array((v @ centres.T).argmax(1).astype(np.int32))], names=["chunk_id", "embedding", "cell"])

    kind = dict(chunks.dtypes)["embedding"]
    return chunks.where("chunk_id is not null and embedding is not null").select("chunk_id", "embedding").mapInArrow(assign, f"chunk_id bigint, embedding {kind}, cell int")


def probes_for(chunks: DataFrame, questions: DataFrame, centres: np.ndarray, k: int = 30, recall: float = 0.95, sample: int = 200) -> int:
    """The least number of cells to look at for ``recall`` on a bounded sample of questions, against the exact search."""
    few = cut(questions.where("question_id is not null and vector is not null").orderBy(F.xxhash64("question_id"), "question_id").limit(sample).select("question_id", "vector"))
    exact = cut(dense_topk(chunks, few, k).select("question_id", "chunk_id"))
    cell = with_cells(chunks.join(exact.select("chunk_id").distinct(), "chunk_id", "left_semi"), centres).select("chunk_id", "cell").dropDuplicates(["chunk_id"])
    rows = exact.join(cell, "chunk_id").collect()  # at most sample x k
    vectors = {r.question_id: np.array(r.vector, np.float64) for r in few.collect()}
    place = {q: np.argsort(np.argsort(-(centres @ v))) for q, v in vectors.items()}
    depths = np.sort([place[r.question_id][r.cell] for r in rows])
    return int(depths[min(len(depths) - 1, int(np.ceil(recall * len(depths))))]) + 1 if len(depths) else 1


class _Nearest:
    """The best k of a task for each question, ties by id; memory is questions × k."""

    def __init__(self, questions: int, k: int) -> None:
        self.k = k
        self.distance = np.full((questions, k), np.inf)
        self.ids = np.zeros((questions, k), np.int64)

    def offer(self, start: int, distance: np.ndarray, ids: np.ndarray) -> None:
        """Distances of a block of questions (rows) to ``ids`` (columns)."""
        n, k = distance.shape[0], self.k
        limit = self.distance[start : start + n, -1].copy()
        if distance.shape[1] > k:
            limit = np.minimum(limit, _kth(distance, ids, k))
        row, column = np.nonzero(distance <= limit[:, None])
        rows = np.concatenate([row, np.repeat(np.arange(n), k)])
        values = np.concatenate([distance[row, column], self.distance[start : start + n].ravel()])
        named = np.concatenate([ids[column], self.ids[start : start + n].ravel()])
        order = np.lexsort((values, named, rows))  # an id keeps its least distance
        first = np.ones(len(order), bool)
        first[1:] = (np.diff(rows[order]) != 0) | (np.diff(named[order]) != 0) | ~np.isfinite(values[order][1:])
        order = order[first]
        order = order[np.lexsort((named[order], values[order], rows[order]))]
        place = np.arange(len(order)) - np.searchsorted(rows[order], np.arange(n))[rows[order]]
        order = order[place < k]
        self.distance[start : start + n], self.ids[start : start + n] = np.inf, 0
        spot = rows[order] + start, place[place < k]
        self.distance[spot], self.ids[spot] = values[order], named[order]

    def kept(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, column = np.nonzero(np.isfinite(self.distance))
        return row, self.ids[row, column], self.distance[row, column]


def dense_topk(chunks: DataFrame, questions: DataFrame, k: int = 30, block: int = BLOCK, digits: int = 6, centres: np.ndarray | None = None, probes: int = 8) -> DataFrame:
    """question_id, chunk_id, dense_distance (rounded), dense_rank of each question's nearest ``k`` chunks.

    ``chunks``: chunk_id, embedding; ``questions``: question_id, vector. Null and zero vectors take no part. With
    ``centres`` (of ``train_cells``) the chunks of a question's ``probes`` nearest cells are looked at; a column cell
    (``with_cells``) is used if ``chunks`` has one.
    """
    asked = questions.where("question_id is not null and vector is not null").select("question_id", "vector").dropDuplicates(["question_id"])
    near = chunks.where("chunk_id is not null and embedding is not null")
    if centres is not None:
        near = (near if "cell" in chunks.columns else with_cells(near, centres)).select("chunk_id", "embedding", "cell")
    else:
        near = near.select("chunk_id", "embedding")
    out = None
    rows = asked.toLocalIterator()
    while part := [r for _, r in zip(range(block), rows)]:
        ids = np.array([r.question_id for r in part], np.int64)
        q = np.array([r.vector for r in part], np.float64)
        size = np.linalg.norm(q, axis=1)
        ids, q = ids[size > 0], (q[size > 0].T / size[size > 0]).T
        looked = None if centres is None else (-(q @ centres.T)).argsort(1, kind="stable")[:, :probes]
        found = near if looked is None else near.where(F.col("cell").isin(np.unique(looked).tolist()))  # cells that nobody asks for aren't read

        def nearest(batches: Iterator[pa.RecordBatch], ids: np.ndarray = ids, q: np.ndarray = q, looked: np.ndarray | None = looked) -> Iterator[pa.RecordBatch]:
            askers = None if looked is None else {c: np.nonzero((looked == c).any(1))[0] for c in np.unique(looked)}
            best = {None: _Nearest(len(ids), k)} if askers is None else {c: _Nearest(len(a), k) for c, a in askers.items()}
            for b in batches:
                if not b.num_rows:
                    continue
                own, v = b.column(0).to_numpy(), _matrix(b.column(1), b.num_rows)
                size = np.linalg.norm(v, axis=1)
                cells = None if askers is None else b.column(2).to_numpy()
                for c in best:
                    mine = size > 0 if cells is None else (size > 0) & (cells == c)
                    if not mine.any():
                        continue
                    asking = q if askers is None else q[askers[c]]
                    w = v[mine] / size[mine, None]
                    for start in range(0, len(asking), 256):
                        best[c].offer(start, np.round(1.0 - asking[start : start + 256] @ w.T, digits) + 0.0, own[mine])
            for c, kept in best.items():
                row, found, distance = kept.kept()
                yield pa.RecordBatch.from_arrays([pa.array(ids[row if askers is None else askers[c][row]]), pa.array(found), pa.array(distance)], names=["question_id", "chunk_id", "dense_distance"])

        found = spread(found, chunks).mapInArrow(nearest, "question_id bigint, chunk_id bigint, dense_distance double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return questions.sparkSession.createDataFrame([], "question_id bigint, chunk_id bigint, dense_distance double, dense_rank int")
    w = Window.partitionBy("question_id").orderBy("dense_distance", "chunk_id")
    least = out.groupBy("question_id", "chunk_id").agg(F.min("dense_distance").alias("dense_distance"))
    return least.withColumn("dense_rank", F.row_number().over(w)).where(F.col("dense_rank") <= k)


def _analyzed(df: DataFrame, key: str, analyzer: str, only: frozenset | None = None) -> DataFrame:
    """key, token, positions: one row for each lexeme of each text, of ``only`` these if they are given."""

    def split(keys: list, texts: list) -> tuple:
        rows: list = []
        for i, text in zip(keys, texts):
            places: dict[str, list[int]] = {}
            for t, p in analyze(text, analyzer):
                if only is None or t in only:
                    places.setdefault(t, []).append(p)
            rows += [(i, t, ps) for t, ps in places.items()]
        return columns(rows, 3)

    return map_columns(df.select(key, "text").where(F.col("text").isNotNull()), split, f"{key} bigint, token string, positions array<int>")


def postings(chunks: DataFrame, analyzer: str = "simple", only: frozenset | None = None) -> DataFrame:
    """chunk_id, token, positions of all chunks (chunk_id, text); a table to keep, bucketed or sorted by token."""
    made = _analyzed(chunks.where("chunk_id is not null"), "chunk_id", analyzer, only)
    return made.groupBy("chunk_id", "token").agg(F.max("positions").alias("positions"))


def stored_postings(chunks: DataFrame) -> DataFrame:
    """The same from the chunks' stored column tsv (positions by lexeme), as the ingest writes it."""
    return chunks.where("chunk_id is not null").select("chunk_id", F.explode("tsv").alias("token", "positions"))


def _matched(chunks: DataFrame, asked: dict[int, frozenset], k: int, rank: str, analyzer: str) -> DataFrame:
    """question_id, chunk_id, sparse_score: a task's best ``k`` chunks of each question. A question is tried on the chunks
    that hold the lexeme of it that the fewest questions have."""
    often = Counter(t for tokens in asked.values() for t in tokens)
    anchored: dict[str, list[int]] = {}
    for q, tokens in asked.items():
        anchored.setdefault(min(tokens, key=lambda t: (often[t], t)), []).append(q)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, dict[int, float]] = {}
        for b in batches:
            for c, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                places: dict[str, list[int]] = {}
                for t, p in analyze(text, analyzer):
                    places.setdefault(t, []).append(p)
                for t in anchored.keys() & places.keys():
                    for q in anchored[t]:
                        tokens = asked[q]
                        if tokens <= places.keys():
                            score = sum(len(places[x]) for x in tokens) * 0.1 if rank == "frequency" else cover_rank([places[x] for x in sorted(tokens)])
                            kept = best.setdefault(q, {})
                            kept[c] = max(round(score, 6), kept.get(c, 0.0))
                            if len(kept) > 4 * k:
                                best[q] = dict(sorted(kept.items(), key=lambda x: (-x[1], x[0]))[:k])
        rows = [(q, c, x) for q, kept in best.items() for c, x in sorted(kept.items(), key=lambda x: (-x[1], x[0]))[:k]]
        kinds = (pa.int64(), pa.int64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns(rows, 3), kinds)], names=["question_id", "chunk_id", "sparse_score"])

    own = chunks.where("chunk_id is not null and text is not null").select("chunk_id", "text")
    return spread(own, chunks).mapInArrow(scan, "question_id bigint, chunk_id bigint, sparse_score double")


def _joined(posting: DataFrame, wanted: DataFrame, rank: str) -> DataFrame:
    """The same by joins over kept postings: each question first meets the chunks that hold its rarest lexeme."""
    needed = wanted.groupBy("question_id").agg(F.count("*").alias("_needed"))
    posting = cut(posting.join(small_side(wanted.select("token").distinct(), MAX_TOKENS), "token", "left_semi"))
    often = posting.groupBy("token").agg(F.count("*").alias("_spread"))
    rated = wanted.join(often, "token", "left").withColumn("_spread", F.coalesce("_spread", F.lit(0)))
    rarest = rated.groupBy("question_id").agg(F.min_by("token", F.struct("_spread", "token")).alias("token"), F.min("_spread").alias("_least")).where("_least > 0")
    pairs = posting.select("chunk_id", "token").join(rarest.select("question_id", "token"), "token").select("question_id", "chunk_id")
    held = pairs.join(wanted, "question_id").join(posting, ["chunk_id", "token"])
    if rank == "frequency":
        scored = held.groupBy("question_id", "chunk_id").agg(F.count("*").alias("_n"), F.round(F.sum(F.size("positions")) * 0.1, 6).alias("sparse_score"))
    else:
        merged = held.groupBy("question_id", "chunk_id").agg(F.count("*").alias("_n"), F.collect_list("positions").alias("_positions"))

        def score(q: list, c: list, n: list, positions: list) -> tuple:
            return q, c, n, [round(cover_rank(p), 6) for p in positions]

        scored = map_columns(merged, score, "question_id bigint, chunk_id bigint, _n bigint, sparse_score double")
    return scored.join(needed, "question_id").where("_n = _needed").select("question_id", "chunk_id", "sparse_score")


def sparse_topk(chunks: DataFrame, questions: DataFrame, k: int = 30, rank: str = "frequency", analyzer: str = "simple", stored: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """question_id, chunk_id, sparse_score, sparse_rank of each question's best ``k`` chunks that hold all its lexemes.

    ``chunks``: chunk_id, text; ``questions``: question_id, text. ``rank``: 'frequency' (0.1 a hit) or
    'cover' (cover density by positions). ``stored``: ``postings`` of the chunks by the same analyzer, else the chunks
    are read once for each ``block`` of questions. Blank questions, and those of stop words only, match nothing.
    """
    ask = questions.where("question_id is not null and trim(text) <> ''").select("question_id", "text").dropDuplicates(["question_id"])
    out = None
    if stored is not None:
        out = _joined(stored, cut(_analyzed(ask, "question_id", analyzer).select("question_id", "token")), rank)
    else:
        rows = ask.toLocalIterator()
        while part := [r for _, r in zip(range(block), rows)]:
            asked = {r.question_id: frozenset(t for t, _ in analyze(r.text, analyzer)) for r in part}
            found = _matched(chunks, {q: t for q, t in asked.items() if t}, k, rank, analyzer)
            out = found if out is None else out.unionByName(found)
    if out is None:
        return questions.sparkSession.createDataFrame([], "question_id bigint, chunk_id bigint, sparse_score double, sparse_rank int")
    w = Window.partitionBy("question_id").orderBy(F.desc("sparse_score"), "chunk_id")
    best = out.groupBy("question_id", "chunk_id").agg(F.max("sparse_score").alias("sparse_score"))
    return best.withColumn("sparse_rank", F.row_number().over(w)).where(F.col("sparse_rank") <= k)


def fuse(dense: DataFrame, sparse: DataFrame, rrf_k: int = 60, top_k: int = 8) -> DataFrame:
    """One ranking a question by the sum over legs of 1 / (rrf_k + rank); ties by chunk id as text."""
    both = dense.join(sparse, ["question_id", "chunk_id"], "full_outer")
    leg = lambda c: F.coalesce(F.lit(1.0) / (F.lit(rrf_k) + F.col(c)), F.lit(0.0))
    both = both.withColumn("rrf_score", leg("dense_rank") + leg("sparse_rank"))
    w = Window.partitionBy("question_id").orderBy(F.round("rrf_score", 15).desc(), F.col("chunk_id").cast("string"))
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)


def hybrid_search(
    chunks: DataFrame, documents: DataFrame, questions: DataFrame, dense_k: int = 30, sparse_k: int = 30, rrf_k: int = 60, top_k: int = 8, rank: str = "frequency", analyzer: str = "simple"
) -> DataFrame:
    """The retrieved chunks of each question: both legs over chunks of active documents, fused, with their texts.

    ``chunks``: chunk_id, document_id, ordinal, heading_path, url_anchor, text, embedding; ``documents``:
    document_id, url, title, is_active; ``questions``: question_id, text, vector.
    """
    active = documents.where("is_active").groupBy("document_id").agg(F.max(F.struct("url", "title")).alias("_d")).select("document_id", "_d.url", "_d.title")
    live = chunks.join(small_side(active.select("document_id")), "document_id", "left_semi")
    asked = cut(questions.where("trim(text) <> ''").select("question_id", "text", "vector"))
    top = cut(fuse(dense_topk(live, asked, dense_k), sparse_topk(live, asked, sparse_k, rank, analyzer), rrf_k, top_k))
    wanted = small_side(top.select("chunk_id").distinct())
    shown = ("document_id", "ordinal", "text", "heading_path", "url_anchor")
    own = live.join(wanted, "chunk_id", "left_semi").groupBy("chunk_id").agg(F.max(F.struct(*shown)).alias("_c")).select("chunk_id", "_c.*").join(active, "document_id")
    return top.join(own, "chunk_id").select(
        "question_id", "chunk_id", "document_id", "ordinal", "url", "title", "text", "heading_path", "url_anchor", "dense_rank", "dense_distance", "sparse_rank", "sparse_score", "rrf_score", "rank"
    )
