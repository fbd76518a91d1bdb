"""Encoding of a whole corpus with a public byte-level BPE tokenizer (problem 8).

Overlapping chunk encoding: a text is pre-tokenised in parallel pieces that meet where pre-token boundaries
resynchronise. A single space between two visible characters is such a place for the pattern of the public rank
files, whatever stands further away: the boundary is right before the space. Texts over ``CHUNK`` characters are cut
in the JVM at the first such place in the overlap behind each multiple of ``CHUNK`` (none there: the chunk stays
joined to the one before), their pieces are spread over tasks, and the ids stitched in order. Inside a piece the same
places split it into segments whose ids are kept in a bounded table of the worker, so repeated words cost one lookup.

Decoding concatenates the raw bytes of the ids. Defined cases: null and empty texts have no ids (an empty list);
special tokens' strings are ordinary text; repeated rows stay repeated; extra columns are ignored.
The vocabulary's path is a parameter; nothing is copied.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CHUNK = 32_768
OVERLAP = 4_096
KEPT_SEGMENTS = 100_000
KEPT_LENGTH = 40

_RESYNC = re.compile(r"(?<=[!-~\w]) (?=[!-~\w])")
_UNSAFE = re.compile(r"[^!-~\w] | [^!-~\w]|^ | $")
_RESYNC_JVM = r"(?s)^(.*?[!-~\p{L}\p{Nd}]) [!-~\p{L}\p{Nd}]"  # the group's length counts code points


class Segments(dict):
    """Ids by segment, looked up once; at most ``KEPT_SEGMENTS`` short ones are kept."""

    def __init__(self, vocabulary: str) -> None:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(vocabulary).read_bytes().splitlines())}
        self.encoding = tiktoken.Encoding(Path(vocabulary).stem, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes = {i: b for b, i in ranks.items()}

    def __missing__(self, segment: str) -> tuple[int, ...]:
        ids = tuple(self.encoding.encode_ordinary(segment))
        if len(segment) <= KEPT_LENGTH:
            if len(self) >= KEPT_SEGMENTS:
                self.clear()
            self[segment] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        return list(chain.from_iterable(map(self.__getitem__, _segments(text))))

    def count(self, text: str | None) -> int:
        return sum(map(len, map(self.__getitem__, _segments(text)))) if text else 0

    def decode(self, ids: list[int] | None) -> str | None:
        return None if ids is None else b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


def _segments(text: str) -> list[str]:
    parts = text.split(" ") if not _UNSAFE.search(text) else _RESYNC.split(text)
    return [parts[0], *[" " + p for p in parts[1:]]]


@functools.lru_cache(maxsize=2)
def tokenizer(vocabulary: str = VOCABULARY) -> Segments:
    """The worker's tokenizer, loaded once."""
    return Segments(vocabulary)


def _encode(df: DataFrame, vocabulary: str, kind: str) -> DataFrame:
    """_text becomes ids; other columns pass through as they are."""
    names = [c for c in df.columns if c != "_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = tokenizer(vocabulary)
        for b in batches:
            each = [table.encode(t) for t in b.column("_text").to_pylist()]
            ends = np.cumsum([0, *map(len, each)], dtype=np.int32)
            flat = np.fromiter(chain.from_iterable(each), np.int32, count=int(ends[-1]))
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.ListArray.from_arrays(ends, flat)], names=[*names, "ids"])

    return df.mapInArrow(run, f"{kind}, ids array<int>")


def _kinds(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name in names)


def encode_corpus(df: DataFrame, doc: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc, ids: the ids of each row's text without special tokens."""
    own = df.select(F.col(doc).alias("_doc"), F.col(text).alias("_text"))
    is_long = F.coalesce(F.char_length("_text") > chunk, F.lit(False))
    short = _encode(own.where(~is_long), vocabulary, _kinds(own, ["_doc"]))

    long = own.where(is_long).withColumn("_hash", F.xxhash64("_text"))
    starts = F.sequence(F.lit(chunk), F.char_length("_text") - 1, F.lit(chunk))
    found = F.transform(starts, lambda s: F.struct(s.alias("s"), F.char_length(F.regexp_extract(F.substring(F.col("_text"), s, F.lit(overlap)), _RESYNC_JVM, 1)).alias("at")))
    cuts = F.transform(F.filter(found, lambda x: x["at"] > 0), lambda x: x["s"] + x["at"])  # 1-based place of the space
    long = long.withColumn("_from", F.concat(F.array(F.lit(1)), cuts)).withColumn("_to", F.concat(cuts, F.array(F.char_length("_text") + 1)))
    spans = F.arrays_zip("_from", "_to")
    pieces = long.select("_doc", "_hash", "_text", F.posexplode(spans).alias("_no", "_span"))
    pieces = pieces.select("_doc", "_hash", "_no", F.substring(F.col("_text"), F.col("_span._from"), F.col("_span._to") - F.col("_span._from")).alias("_text"))
    pieces = _encode(pieces.repartition("_doc", "_hash", "_no"), vocabulary, _kinds(pieces, ["_doc", "_hash", "_no"]))
    whole = pieces.groupBy("_doc", "_hash").agg(F.collect_set(F.struct("_no", "ids")).alias("parts"), F.count_if(F.col("_no") == 0).cast("int").alias("copies"))
    ids = F.flatten(F.transform(F.array_sort("parts"), lambda p: p["ids"]))
    stitched = whole.select("_doc", ids.alias("ids"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).drop("_copy")
    return short.unionByName(stitched).withColumnRenamed("_doc", doc)


def count_tokens(df: DataFrame, text: str = "text", out: str = "n_tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """``df`` without ``text``, with the number of its tokens."""
    names = [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = tokenizer(vocabulary)
        for b in batches:
            n = pa.array([table.count(t) for t in b.column(text).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), n], names=[*names, out])

    return df.mapInArrow(run, f"{_kinds(df, names)}, {out} bigint")


def decode_corpus(df: DataFrame, ids: str = "ids", out: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``df`` with the text of ``ids``."""
    kinds = _kinds(df, df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = tokenizer(vocabulary)
        for b in batches:
            texts = pa.array([table.decode(x) for x in b.column(ids).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, texts], names=[*b.schema.names, out])

    return df.mapInArrow(run, f"{kinds}, {out} string")
