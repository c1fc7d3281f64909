"""Exact duplicates, by streams over the documents with keyed state on disk.

One stream reads texts and writes each document's id, digest and content locator (file and id).
A second one keeps a state row per digest in RocksDB and never lets it expire: the digest, the
smallest document id seen (the stable identifier), its content locator and the number of copies.
Copies are combined within each task before they reach the state, so a text that a third of the
documents share is no heavier than others.

A digest seen twice is only a hit. All hits are read again and their bytes compared with those at
the content locator; documents that only share a digest become groups of their own.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallybook.llm.keys import join_counted, maybe_among
from tallybook.llm.storage import shared_path, stored

SPACE = r"[\x20\x09-\x0D]+"
COPIES_PER_SALT = 256

_STATE = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Many small stores would set aside megabytes of disk each.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalized(text: Column) -> Column:
    """White space runs as one space each; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def exact_duplicates(
    spark: SparkSession,
    path: str,
    digest: Callable[[Column], Column] = sha256,
    files_per_batch: int = 1000,
) -> DataFrame:
    """``doc_id, digest, keep_id, copies`` for every row of the parquet table at ``path``.

    ``keep_id`` is the smallest id among the documents of equal normalised text, ``copies`` their
    number. Null text is empty text. Null ids come last among ids; rows that repeat an id and a
    text count as copies and have the same answer. An empty table gives no rows, and columns
    other than ``doc_id`` and ``text`` are not read.
    """
    path = path.rstrip("/")
    schema = spark.read.parquet(path).select("doc_id", "text").schema
    digests = _stream_digests(spark, path, schema, digest, files_per_batch)
    state = _stream_state(spark, digests, files_per_batch)
    rows = spark.read.schema(digests.schema).parquet(digests.path)
    total = state.agg(F.sum("copies")).first()[0] or 0
    answer = join_counted(rows, state, "digest", "copies", total)

    # Texts are read again only where a document may have copies.
    repeated = stored(answer.where("copies > 1"), "repeated")
    texts = spark.read.schema(schema).parquet(path).select(
        F.col("doc_id").alias("_id"), F.col("_metadata.file_path").alias("_path"), "text"
    )
    near = maybe_among(texts, repeated.select(F.col("doc_id").alias("_id")), ["_id"], True)
    hits = stored(
        repeated.distinct().join(
            near.select("_id", "_path", normalized(F.col("text")).alias("_text")),
            F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("file") == F.col("_path")),
        ).drop("_id", "_path"),
        "hits",
    ).where(digest(F.col("_text")) == F.col("digest"))
    if hits.count() != repeated.count():
        raise RuntimeError(f"documents changed while they were read: {path}")
    answer = answer.select("doc_id", "digest", "keep_id", "copies")
    unequal = _unequal(hits)
    if unequal.isEmpty():
        return answer
    # Some digests stand for several texts: their documents are grouped by the text itself.
    collided = stored(unequal.select("digest").distinct(), "collided")
    apart = hits.join(collided, "digest", "left_semi").select("doc_id", "digest", "_text")
    groups = apart.groupBy("digest", "_text").agg(
        F.min("doc_id").alias("keep_id"), F.count("*").alias("copies")
    )
    return answer.join(collided, "digest", "left_anti").unionByName(
        apart.join(groups, ["digest", "_text"]).drop("_text")
    )


@dataclass
class _Written:
    path: str
    schema: StructType


def _stream_digests(
    spark: SparkSession,
    path: str,
    schema: StructType,
    digest: Callable[[Column], Column],
    files_per_batch: int,
) -> _Written:
    """Id, digest and locator of each document, written file by file."""
    rows = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        # A stream takes a folder or a pattern; this pattern is the path itself, folder or file.
        .parquet(f"{path[:-1]}[{path[-1]}]")
        .select(
            "doc_id",
            digest(normalized(F.col("text"))).alias("digest"),
            F.col("_metadata.file_path").alias("file"),
        )
    )
    written = _Written(shared_path(spark, "digests"), rows.schema)
    query = (
        rows.writeStream.format("parquet")
        .option("path", written.path)
        .option("checkpointLocation", shared_path(spark, "digests-log"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    spark.createDataFrame([], rows.schema).write.mode("append").parquet(written.path)
    return written


def _stream_state(spark: SparkSession, digests: _Written, files_per_batch: int) -> DataFrame:
    """The state after all digests there are: ``digest, keep_id, keep_file, copies``."""
    rows = (
        spark.readStream.schema(digests.schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(digests.path)
    )
    state = rows.groupBy("digest").agg(
        F.min("doc_id").alias("keep_id"),
        # Null ids last, here as in the minimum.
        F.min_by("file", F.struct(F.col("doc_id").isNull(), "doc_id", "file")).alias("keep_file"),
        F.count("*").alias("copies"),
    )
    updates = shared_path(spark, "state-updates")

    def keep(batch: DataFrame, number: int) -> None:
        # Written over if the batch has to run again.
        batch.write.mode("overwrite").parquet(f"{updates}/batch={number}")

    before = {key: spark.conf.get(key, None) for key in _STATE}
    for key, value in _STATE.items():
        spark.conf.set(key, value)
    try:
        query = (
            state.writeStream.outputMode("update")
            .option("checkpointLocation", shared_path(spark, "state"))
            .trigger(availableNow=True)
            .foreachBatch(keep)
            .start()
        )
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    query.awaitTermination()
    if not query.recentProgress:
        return spark.createDataFrame([], state.schema)
    # A digest's later rows replace its earlier ones: its copies only grow, its least id falls.
    return (
        spark.read.schema(state.schema)
        .option("basePath", updates)
        .parquet(f"{updates}/batch=*")
        .groupBy("digest")
        .agg(
            F.max_by(F.struct("keep_id", "keep_file"), "copies").alias("_last"),
            F.max("copies").alias("copies"),
        )
        .select("digest", "_last.keep_id", "_last.keep_file", "copies")
    )


def _unequal(hits: DataFrame) -> DataFrame:
    """Hits whose text differs from the text at the locator of their digest.

    Large groups are salted: each salt gets the text to compare with, and a few hundred copies.
    """
    salts = F.ceil(F.col("copies") / COPIES_PER_SALT).cast("int")
    is_kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("file") == F.col("keep_file"))
    kept = (
        hits.where(is_kept)
        .groupBy("digest", "copies")
        .agg(F.min("_text").alias("_kept"))
        .select("digest", "_kept", F.explode(F.sequence(F.lit(0), salts - 1)).alias("_salt"))
    )
    salted = hits.select(
        "digest", "_text", F.pmod(F.xxhash64("doc_id", "file"), salts).cast("int").alias("_salt")
    )
    return salted.join(kept, ["digest", "_salt"]).where("_text <> _kept")
