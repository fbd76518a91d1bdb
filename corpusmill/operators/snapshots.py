"""Upserts, deletes and deactivation as whole new snapshots (parquet has no row-level merge).

A snapshot is merged by its key in one shuffle and published under a new version folder; a pointer file is swapped in
one rename, so readers see the old or the new state and never a mixture.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.urls import is_persistable
from corpusmill.session import cut


def document_id_of(url: Column) -> Column:
    """The id of a document that has none yet: the same for the same url, wherever it runs."""
    return F.sha2(url, 256)


def latest_fetches(crawls: DataFrame) -> DataFrame:
    """url, content_hash, http_status, content_type, fetched_at of the last persistable fetch of each url."""
    ok = crawls.where((F.col("status") == "success") & (F.col("http_status") == 200) & (F.col("body_bytes") > 0) & (F.coalesce("content_hash", F.lit("")) != "") & F.col("url").isNotNull())
    newest = ok.groupBy("url").agg(F.max(F.struct("fetched_at", "fetch_id", F.lower("content_hash").alias("content_hash"), "http_status", "content_type")).alias("f"))
    return newest.select("url", "f.content_hash", "f.http_status", "f.content_type", "f.fetched_at")


def persistable(fetches: DataFrame) -> DataFrame:
    """Successful fetches whose body was kept and can be stored."""
    return fetches.where((F.col("status") == "success") & is_persistable(F.col("body"), F.col("content_hash"), F.col("http_status")))


def upsert_documents(stored: DataFrame, fetched: DataFrame) -> DataFrame:
    """url, content_hash, fetched_at, is_active, change of all documents after ``fetched`` (url, content_hash,
    fetched_at): known urls take the new hash and time and keep the rest, new ones are active."""
    old = stored.groupBy("url").agg(F.max_by(F.struct("content_hash", "fetched_at", "is_active"), F.struct("fetched_at", "content_hash")).alias("o")).where("url is not null")
    new = fetched.select("url", F.struct("content_hash", "fetched_at").alias("n"))
    both = old.join(new, "url", "full_outer")
    change = F.when(F.col("o").isNull(), "inserted").when(F.col("n").isNull(), "kept").when(F.lower("o.content_hash").eqNullSafe(F.col("n.content_hash")), "refreshed").otherwise("changed")
    pick = lambda c: F.coalesce(F.when(F.col("n").isNotNull(), F.col(f"n.{c}")), F.col(f"o.{c}")).alias(c)
    return both.select("url", pick("content_hash"), pick("fetched_at"), F.coalesce("o.is_active", F.lit(True)).alias("is_active"), change.alias("change"))


def replace_chunks(stored: DataFrame, fresh: DataFrame, changed: DataFrame) -> DataFrame:
    """All chunks after the documents of ``changed`` (document_id) were chunked again into ``fresh``: same ordinals keep
    their chunk_id, ordinals that are no more are gone, documents chunked to nothing keep nothing.

    New ids: 128 bits of document and ordinal where ids are strings, else numbers above all that are stored."""
    untouched = stored.join(changed.select("document_id").distinct(), "document_id", "left_anti")
    ids = stored.groupBy("document_id", "ordinal").agg(F.min("chunk_id").alias("_id"))
    new = fresh.join(changed.select("document_id").distinct(), "document_id", "left_semi").join(ids, ["document_id", "ordinal"], "left")
    if dict(stored.dtypes)["chunk_id"] == "string":
        made = F.md5(F.concat_ws("\x1f", "document_id", F.col("ordinal").cast("string")))
    else:
        last = stored.agg(F.max("chunk_id")).first()[0]
        new = cut(new.repartitionByRange("document_id", "ordinal").sortWithinPartitions("document_id", "ordinal"))
        made = F.lit(0 if last is None else last) + 1 + F.monotonically_increasing_id()
    new = new.withColumn("chunk_id", F.coalesce("_id", made)).drop("_id")
    return untouched.unionByName(new.select(*[c for c in untouched.columns if c in new.columns]), allowMissingColumns=True)


def excess_ordinals(stored: DataFrame, sizes: DataFrame) -> DataFrame:
    """document_id, ordinal of stored chunks beyond the new number of chunks (``sizes``: document_id, n_chunks)."""
    return stored.select("document_id", "ordinal").distinct().join(sizes, "document_id").where("ordinal >= n_chunks").select("document_id", "ordinal")


def deactivate(documents: DataFrame, chunks: DataFrame, rejected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents with is_active false and no hash for rejected ones, chunks without theirs); rows are kept for audit,
    and a page that comes back is embedded again."""
    drop = rejected.select("document_id").distinct().withColumn("_rejected", F.lit(True))
    marked = documents.join(drop, "document_id", "left")
    out = [F.when(F.col("_rejected"), False).otherwise(F.col(c)).alias(c) if c == "is_active" else F.when(F.col("_rejected").isNull(), F.col(c)).alias(c) if c == "embedded_hash" else F.col(c) for c in documents.columns]
    return marked.select(*out), chunks.join(drop, "document_id", "left_anti")


def embedded_state(embeds: DataFrame) -> DataFrame:
    """document_id, embedded_hash: what was really embedded last."""
    done = embeds.where("skipped = false and finished_at is not null and document_id is not null")
    w = done.groupBy("document_id").agg(F.max(F.struct("finished_at", "run_id", F.lower("content_hash").alias("hash"))).alias("e"))
    return w.select("document_id", F.col("e.hash").alias("embedded_hash"))


def unchanged(documents: DataFrame, embeds: DataFrame) -> DataFrame:
    """document_id of documents whose stored hash is the embedded one: they can be skipped."""
    own = documents.select("document_id", F.lower("content_hash").alias("content_hash")).distinct()
    return own.join(embedded_state(embeds), "document_id").where("content_hash = embedded_hash").select("document_id").distinct()


def publish(df: DataFrame, folder: str, version: str, partition_by: list[str] | None = None) -> str:
    """Writes ``df`` under a new version folder and puts it in force; returns its path."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    path = f"{folder.rstrip('/')}/{version}"
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    hadoop = jvm.org.apache.hadoop.fs
    fresh, pointer = hadoop.Path(f"{folder}/.CURRENT-{version}"), hadoop.Path(f"{folder}/CURRENT")
    fs = pointer.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stream = fs.create(fresh, True)
    stream.write(bytearray(version.encode()))
    stream.close()
    options = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    options[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fresh, pointer, options)
    return path


def current(spark: object, folder: str) -> DataFrame | None:
    """The snapshot in force."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    pointer = hadoop.Path(f"{folder}/CURRENT")
    if not pointer.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(pointer):
        return None
    return spark.read.parquet(f"{folder}/{spark.read.text(f'{folder}/CURRENT').first()[0]}")


def running_number(df: DataFrame, group: str, order: str, name: str = "ordinal") -> DataFrame:
    """0-based place in the group."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1)
