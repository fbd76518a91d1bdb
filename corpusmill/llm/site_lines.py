"""Lines repeated across one site's documents (problem 4).

Lines are keyed by a 64-bit hash of their lower-cased letters; distinct documents are counted per (site, key)
with map-side combining, thresholded by document share, and joined back to the occurrences. Both the key and the
site are in the grouping key and the document is in the first exchange, so a site with a third of all rows spreads
over all tasks. The texts are split and normalised once; their lines' hashes are kept in the shared checkpoint folder and
read for the counts and for the occurrences. At most ``1 / share`` times a site's mean number of lines per document can pass, so the list of
frequent lines is small; it is broadcast only after its rows were counted.

Defined cases: null text gives no lines but its document counts in the share; lines without letters are never
frequent; null sites form one site of their own; repeated rows of a document count once; an empty table gives an
empty result; other columns of the input are ignored by the finder and kept by the cleaner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.session import cut, small_side

MIN_DOCUMENTS = 4
MIN_SHARE = 0.05
MAX_BROADCAST_LINES = 200_000


def line_key(line: Column) -> Column:
    """64-bit hash of a line's letters in lower case; null for lines without letters."""
    letters = F.regexp_replace(F.lower(line), r"[^\p{L}]+", "")
    return F.when(letters != "", F.xxhash64(letters))


def _lines(df: DataFrame, doc: str, site: str, text: str) -> DataFrame:
    own = df.select(F.col(doc).alias("_doc"), F.coalesce(F.col(site), F.lit("")).alias("_site"), F.col(text).alias("_text"))
    split = own.select("_doc", "_site", F.posexplode(F.split("_text", "\n", -1)).alias("_no", "_line"))
    return split.select("_doc", "_site", "_no", line_key(F.col("_line")).alias("_key")).where(F.col("_key").isNotNull())


def _frequent(df: DataFrame, lines: DataFrame, doc: str, site: str, min_documents: int, min_share: float) -> DataFrame:
    sizes = df.groupBy(F.coalesce(F.col(site), F.lit("")).alias("_site")).agg(F.count_distinct(F.col(doc)).alias("site_docs"))
    counts = lines.groupBy("_site", "_key").agg(F.count_distinct("_doc").alias("n_docs")).where(F.col("n_docs") >= min_documents)
    return counts.join(sizes, "_site").where(F.col("n_docs") >= F.col("site_docs") * F.lit(min_share))


def frequent_lines(
    df: DataFrame, doc: str = "document_id", site: str = "host", text: str = "full_text",
    min_documents: int = MIN_DOCUMENTS, min_share: float = MIN_SHARE,
) -> DataFrame:
    """(_site, _key, n_docs, site_docs) of every line standing in enough distinct documents of its site."""
    return _frequent(df, _lines(df, doc, site, text), doc, site, min_documents, min_share)


def repeated_line_occurrences(
    df: DataFrame, doc: str = "document_id", site: str = "host", text: str = "full_text",
    min_documents: int = MIN_DOCUMENTS, min_share: float = MIN_SHARE,
) -> DataFrame:
    """(doc, line_no) of each occurrence of a frequent line, once for repeated rows."""
    lines = cut(_lines(df, doc, site, text))
    often = small_side(_frequent(df, lines, doc, site, min_documents, min_share).select("_site", "_key"), MAX_BROADCAST_LINES)
    return lines.join(often, ["_site", "_key"], "left_semi").select(F.col("_doc").alias(doc), F.col("_no").alias("line_no")).distinct()


def without_repeated_lines(
    df: DataFrame, doc: str = "document_id", site: str = "host", text: str = "full_text",
    min_documents: int = MIN_DOCUMENTS, min_share: float = MIN_SHARE,
) -> DataFrame:
    """``df`` with ``text`` rebuilt without its site's frequent lines; all rows and other columns stay."""
    found = repeated_line_occurrences(df, doc, site, text, min_documents, min_share)
    drop = found.groupBy(F.col(doc).alias("_drop_doc")).agg(F.collect_set("line_no").alias("_drop"))
    joined = df.join(drop, df[doc].eqNullSafe(F.col("_drop_doc")), "left")
    kept = F.filter(F.split(df[text], "\n", -1), lambda line, i: ~F.array_contains(F.coalesce("_drop", F.array().cast("array<int>")), i))
    rebuilt = F.when(F.col("_drop").isNull(), df[text]).otherwise(F.array_join(kept, "\n"))
    return joined.select(*[rebuilt.alias(c) if c == text else df[c] for c in df.columns])
