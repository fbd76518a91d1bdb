"""Near-duplicate records with small edits (problem 7).

HyperMinHash: every three-word shingle is hashed once a pass and falls into one of ``BUCKETS`` buckets; a bucket's
register stores the leading-zero count of its least hash and ``MANTISSA`` bits behind it (16 bits together). Bands of
registers are hashed and joined, the candidates' Jaccard likeness is estimated from all registers with correction for
chance collisions and for buckets empty on both sides, and what is not clearly below the threshold is verified on the
exact shingle sets of the whole texts.

A record of few distinct shingles leaves many registers empty; up to ``FEW`` of them it also has a band for each
shingle, so that no such pair is missed.

Records with the same words in the same order are one class and only its first record is banded, so masses of exact
copies cost one row each; buckets of one record are dropped before the join. No bucket, candidate or partner is
capped. ``similar_pairs`` lists all pairs (its rows are what the data hold); ``groups`` gives one row a record.

Defined cases: null, empty and short texts (under ``MIN_PIECES`` pieces between white space) are in no pair; repeated
rows are one record; texts of fewer than three words have no shingles; ids are unique within a kind.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.arrow import map_columns
from corpusmill.session import cut, small_side

SHINGLE = 3
THRESHOLD = 0.6
MIN_PIECES = 50
PASSES, BUCKETS, MANTISSA = 10, 16, 10
REGISTERS = PASSES * BUCKETS
BAND = 5
#: Each register stands in two bands, one of each arrangement of the registers.
BANDS = [row.tolist() for seed in (1, 2) for row in np.random.RandomState(seed).permutation(REGISTERS).reshape(-1, BAND)]
#: A record of up to ``FEW`` / 0.6 distinct shingles can be like one whose bands are mostly empty.
FEW = 20
#: An estimate this far (over four standard deviations) below the threshold can't be a pair.
MARGIN = 0.2

#: Lists of ids are broadcast up to this many (about 50 MB), and joined by shuffle beyond.
MAX_BROADCAST_IDS = 1_000_000

_WORD = re.compile(r"[^\W_]+")
_ASCII = bytes(c if chr(c).isalnum() else 32 for c in range(128)) + bytes(range(128, 256))
_EMPTY = 0xFFFF


def words(text: str) -> list[str]:
    """Maximal runs of letters and digits of the lower-cased text."""
    low = text.lower()
    return low.encode().translate(_ASCII).decode().split() if low.isascii() else _WORD.findall(low)


def shingles(text: str, size: int = SHINGLE) -> set[str]:
    w = words(text)
    return {" ".join(w[i : i + size]) for i in range(len(w) - size + 1)}


class _Hashes(dict):
    """64-bit hash by word; at most 300,000 are kept."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= 300_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def registers(texts: list[list[str]], hashes: dict) -> np.ndarray:
    """One row of ``REGISTERS`` 16-bit registers for each list of words."""
    n = len(texts)
    lengths = np.fromiter(map(len, texts), np.int64, n)
    flat = np.fromiter((h for t in texts for h in map(hashes.__getitem__, t)), np.uint64, int(lengths.sum()))
    size, low = len(flat), np.full((n, REGISTERS), ~np.uint64(0))
    if size >= SHINGLE:
        h = np.zeros(size - SHINGLE + 1, np.uint64)
        for k in range(SHINGLE):
            h = _mix(h * np.uint64(3) + flat[k : size - SHINGLE + 1 + k] + np.uint64(k))
        owner = np.repeat(np.arange(n), lengths)
        inside = owner[: len(h)] == owner[SHINGLE - 1 :]
        h, row = h[inside], owner[: len(inside)][inside] * REGISTERS
        table = low.reshape(-1)
        for p in range(PASSES):
            g = _mix(h + np.uint64((p + 1) * 0x632BE59BD9B4E019 & (1 << 64) - 1))
            np.minimum.at(table, row + p * BUCKETS + (g >> np.uint64(60)).astype(np.int64), g & np.uint64((1 << 60) - 1))
    filled = low != ~np.uint64(0)
    top = np.where(filled, np.maximum(low, np.uint64(1 << MANTISSA)), np.uint64(1 << MANTISSA))
    exponent = np.frexp(top.astype(np.float64))[1] - 1  # place of the leading one; a float may round up to the next power
    exponent -= ((top >> exponent.astype(np.uint64)) == 0).astype(exponent.dtype)
    mantissa = (top >> (exponent - MANTISSA).astype(np.uint64)).astype(np.int64) & ((1 << MANTISSA) - 1)
    return np.where(filled, (59 - exponent) << MANTISSA | mantissa, _EMPTY).astype("<u2")


def folded(r: np.ndarray) -> np.ndarray:
    """Registers as one byte each, all that the estimate needs; 255 is empty."""
    return np.where(r == _EMPTY, 255, (r.astype(np.uint32) * 40503 >> 7) % 255).astype(np.uint8)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Likeness by row of two arrays of folded registers, corrected for chance collisions."""
    there = ((a != 255) | (b != 255)).sum(1)
    same = ((a == b) & (a != 255)).sum(1)
    chance = there * (1 / (3.0 * (1 << MANTISSA)) + 1 / 255)  # the same register, or the same byte of two registers
    return np.where(there > 0, np.clip((same - chance) / np.maximum(there - chance, 1), 0, 1), 0.0)


def _few(w: list[str]) -> list[int] | None:
    """Hashes of a text's shingles if there are at most ``FEW``."""
    own: set[str] = set()
    for i in range(len(w) - SHINGLE + 1):
        own.add(" ".join(w[i : i + SHINGLE]))
        if len(own) > FEW:
            return None
    return sorted(int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little", signed=True) for x in own)


def signatures(df: DataFrame, kind: str, record: str, document: str, text: str, min_pieces: int = MIN_PIECES) -> DataFrame:
    """kind, id, doc, class (MD5 of the words), registers, few (hashes of the shingles if they are few) of every record
    that is long enough."""

    def sign(ids: list, docs: list, texts: list) -> tuple:
        out: tuple = ([], [], [], [], [], [])
        hashes, batch, size = _Hashes(), [], 0

        def flush() -> None:
            nonlocal batch, size
            if batch:
                for (x, d, w), r in zip(batch, registers([w for _, _, w in batch], hashes)):
                    few = _few(w) if (r == _EMPTY).sum() > REGISTERS // 10 else None
                    for column, value in zip(out, (kind, x, d, hashlib.md5(" ".join(w).encode()).digest(), r.tobytes(), few)):
                        column.append(value)
            batch, size = [], 0

        for x, d, t in zip(ids, docs, texts):
            if x is None or t is None or len(t.split(None, min_pieces)) < min_pieces:
                continue
            w = words(t)
            if len(w) >= SHINGLE:
                batch.append((x, d, w))
                size += len(w)
                if size > 100_000:
                    flush()
        flush()
        return out

    own = df.select(F.col(record).cast("bigint").alias("id"), F.col(document).cast("bigint").alias("doc"), F.col(text).alias("text"))
    return map_columns(own, sign, "kind string, id bigint, doc bigint, class binary, registers binary, few array<bigint>")


def band_keys(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys by record and band, whether the band counts: at most two of its registers are empty)."""
    keys = np.zeros((len(r), len(BANDS)), np.uint64)
    gaps = np.zeros((len(r), len(BANDS)), np.int64)
    for j in range(BAND):
        column = r[:, [b[j] for b in BANDS]]
        keys = _mix(keys * np.uint64(5) + column.astype(np.uint64) + np.uint64(1))
        gaps += column == _EMPTY
    return _mix(keys + np.arange(len(BANDS), dtype=np.uint64)).view(np.int64), gaps < 3


def _banded(reps: DataFrame) -> DataFrame:
    """kind, id, band: one row a record and band."""

    def band(kinds: list, ids: list, rows: list) -> tuple:
        keys, good = band_keys(np.frombuffer(b"".join(rows), "<u2").reshape(len(rows), -1))
        at = np.nonzero(good)[0]
        return [kinds[i] for i in at], np.array(ids, np.int64)[at], keys[good]

    banded = map_columns(reps.select("kind", "id", "registers"), band, "kind string, id bigint, band bigint")
    return banded.unionByName(reps.where("few is not null").select("kind", "id", F.explode("few").alias("band")))


def _candidates(reps: DataFrame) -> DataFrame:
    """kind, a, b (a < b) of the records that share a band; the join's keys are single bands, buckets of one are gone."""
    w = Window.partitionBy("kind", "band").orderBy("id")
    shared = _banded(reps).select("kind", "band", "id", F.lag("id").over(w).alias("_low"), F.lead("id").over(w).alias("_high"))
    shared = cut(shared.where(F.coalesce(F.col("_low") < F.col("id"), F.lit(False)) | F.coalesce(F.col("_high") > F.col("id"), F.lit(False))).select("kind", "band", "id"))
    left, right = shared.withColumnRenamed("id", "a"), shared.withColumnRenamed("id", "b")
    return left.join(right, ["kind", "band"]).where("a < b").select("kind", "a", "b").distinct()


def _estimated(candidates: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    fold = lambda kinds, ids, rows: (kinds, ids, [x.tobytes() for x in folded(np.frombuffer(b"".join(rows), "<u2").reshape(len(rows), -1))])
    codes = map_columns(reps.select("kind", "id", "registers"), fold, "kind string, id bigint, codes binary")
    side = lambda x: codes.select("kind", F.col("id").alias(x), F.col("codes").alias(f"_{x}"))
    pairs = candidates.join(side("a"), ["kind", "a"]).join(side("b"), ["kind", "b"]).select("kind", "a", "b", "_a", "_b")

    def keep(kinds: list, a: list, b: list, left: list, right: list) -> tuple:
        matrix = lambda rows: np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)
        good = np.nonzero(estimate(matrix(left), matrix(right)) >= threshold - MARGIN)[0]
        return tuple([column[i] for i in good] for column in (kinds, a, b))

    return map_columns(pairs, keep, "kind string, a bigint, b bigint")


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """kind, a, b, likeness by the exact shingle sets of the whole texts."""
    needed = small_side(pairs.select("kind", F.explode(F.array("a", "b")).alias("id")).distinct(), MAX_BROADCAST_IDS)
    own = cut(texts.join(needed, ["kind", "id"], "left_semi").dropDuplicates(["kind", "id"]))
    side = lambda x: own.select("kind", F.col("id").alias(x), F.col("text").alias(f"_{x}"))
    joined = pairs.join(side("a"), ["kind", "a"]).join(side("b"), ["kind", "b"]).select("kind", "a", "b", "_a", "_b")

    def verify(kinds: list, a: list, b: list, left: list, right: list) -> tuple:
        out: tuple = ([], [], [], [])
        for row in zip(kinds, a, b, left, right):
            x, y = shingles(row[3]), shingles(row[4])
            both = len(x & y)
            likeness = both / (len(x) + len(y) - both) if both else 0.0
            if likeness >= threshold:
                for column, value in zip(out, (*row[:3], likeness)):
                    column.append(value)
        return out

    return map_columns(joined, verify, "kind string, a bigint, b bigint, likeness double")


def _linked(sources: list[tuple[DataFrame, str, str, str, str]], threshold: float, min_pieces: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records: kind, id, doc; members: kind, rep, id, doc of classes of several; links between representatives)."""
    signed = texts = None
    for df, kind, record, document, text in sources:
        s = signatures(df, kind, record, document, text, min_pieces)
        t = df.select(F.lit(kind).alias("kind"), F.col(record).cast("bigint").alias("id"), F.col(text).alias("text"))
        signed, texts = (s, t) if signed is None else (signed.unionByName(s), texts.unionByName(t))
    signed = cut(signed)
    classes = signed.groupBy("kind", "class").agg(F.min("id").alias("rep"), F.max("id").alias("_last")).where("rep <> _last").drop("_last")
    members = cut(signed.select("kind", "class", "id", "doc").join(classes, ["kind", "class"]).select("kind", "rep", "id", "doc").distinct())
    reps = signed.join(small_side(members.where("id <> rep").select("kind", "id"), MAX_BROADCAST_IDS), ["kind", "id"], "left_anti")
    links = cut(_verified(cut(_estimated(_candidates(reps), reps, threshold)), texts, threshold))
    return signed.select("kind", "id", "doc"), members, links


def similar_pairs(sources: list[tuple[DataFrame, str, str, str, str]], threshold: float = THRESHOLD, min_pieces: int = MIN_PIECES) -> DataFrame:
    """kind, id_a, id_b (id_a < id_b) of different documents' records with likeness >= ``threshold``.

    ``sources``: (frame, kind, record column, document column, text column).
    """
    records, members, links = _linked(sources, threshold, min_pieces)
    ends = links.select("kind", F.explode(F.array("a", "b")).alias("rep")).distinct()
    alone = records.withColumn("rep", F.col("id")).join(ends, ["kind", "rep"], "left_semi").join(members.select("kind", "id"), ["kind", "id"], "left_anti").distinct()
    every = members.unionByName(alone.select("kind", "rep", "id", "doc"))
    side = lambda df, x, rep: df.select("kind", F.col("rep").alias(rep), F.col("id").alias(f"id_{x}"), F.col("doc").alias(f"doc_{x}"))
    across = links.select("kind", "a", "b").join(side(every, "a", "a"), ["kind", "a"]).join(side(every, "b", "b"), ["kind", "b"])
    within = side(members, "a", "rep").join(side(members, "b", "rep"), ["kind", "rep"]).where("id_a < id_b")
    pairs = across.select("kind", "id_a", "id_b", "doc_a", "doc_b").unionByName(within.select("kind", "id_a", "id_b", "doc_a", "doc_b"))
    return pairs.where(~F.col("doc_a").eqNullSafe(F.col("doc_b"))).select("kind", F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).distinct()


def groups(sources: list[tuple[DataFrame, str, str, str, str]], threshold: float = THRESHOLD, min_pieces: int = MIN_PIECES) -> DataFrame:
    """kind, id, class_id (first record with the same words), group_id (least class of the connected classes),
    n_links (links of its class to other classes) of every record that is long enough."""
    records, members, links = _linked(sources, threshold, min_pieces)
    edges = cut(links.select("kind", "a", "b").unionByName(links.select("kind", F.col("b").alias("a"), F.col("a").alias("b"))))
    label = edges.groupBy("kind", F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label"))
    while True:
        near = edges.join(label.select("kind", F.col("node").alias("b"), F.col("label").alias("_near")), ["kind", "b"])
        least = near.groupBy("kind", F.col("a").alias("node")).agg(F.min("_near").alias("_near"))
        moved = label.join(least, ["kind", "node"]).select("kind", "node", "label", F.least("label", "_near").alias("_to"))
        jump = moved.select("kind", F.col("node").alias("_to"), F.col("_to").alias("_far"))
        after = cut(moved.join(jump, ["kind", "_to"], "left").select("kind", "node", "label", F.least("_to", F.coalesce("_far", "_to")).alias("_new")))
        done = after.where("label <> _new").isEmpty()
        label = after.select("kind", "node", F.col("_new").alias("label"))
        if done:
            break
    counts = edges.groupBy("kind", F.col("a").alias("node")).agg(F.count("*").alias("n_links"))
    own = records.distinct().join(members.select("kind", "id", "rep").distinct(), ["kind", "id"], "left").withColumn("class_id", F.coalesce("rep", "id"))
    out = own.join(label.withColumnRenamed("node", "class_id"), ["kind", "class_id"], "left").join(counts.withColumnRenamed("node", "class_id"), ["kind", "class_id"], "left")
    return out.select("kind", "id", "class_id", F.coalesce("label", "class_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
