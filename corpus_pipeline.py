"""The documents' way to training shards, stage by stage.

``run`` writes what each stage returns as a table of the shared folder and reads it again for the
next one. All stages but the last return the columns of the documents they were given.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.llm import decontamination, langid, ngram_join, sharding
from tallybook.llm.keys import without
from tallybook.llm.queries import mixed
from tallybook.llm.storage import stored

# Documents go whose words give no language more than this share, and those without letters.
LEAST_SHARE = 0.4
WORDS, PERCENT = 5, 80
N_SHARDS = 40
# Texts go to Python tasks in batches of about so many bytes.
BATCH_BYTES = 1 << 21


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that are in a language; it is learnt from those that name theirs.

    Every row is judged by its own whole text, however long; null and empty texts and those without
    a letter go. Repeated rows stay or go alike, null and repeated ids make no difference but to
    what is learnt from. No rows give no rows.
    """
    _bound_batches(spark)
    model = langid.train(docs.where(~langid.held_out()))
    rows = _numbered(docs)
    found = langid.predict(rows, model, ["_row"])
    kept = (F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SHARE)
    return _without(rows, found.where(~kept), "unspoken")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the rows that near-duplicate links connect, keep one: that with the smallest id.

    Null ids come last; of equal ids, repeated rows included, any one row stays. Texts are compared
    whole; null, empty and blank ones are linked with nothing and stay. No rows give no rows.
    """
    _bound_batches(spark)
    rows = _numbered(docs)
    numbers = rows.select(F.col("_row").alias("doc_id"), "text")
    found = ngram_join.similar_documents(numbers, WORDS, PERCENT, count_links=False)
    others = stored(
        found.where("doc_id <> component_id").select(F.col("doc_id").alias("_row"), "component_id"),
        "linked",
    )
    # The row that gives a component its name is in it as well.
    named = others.select("component_id").distinct()
    members = others.unionByName(named.select(F.col("component_id").alias("_row"), "component_id"))
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_row")
    kept = (
        rows.select("_row", "doc_id")
        .join(members, "_row")
        .groupBy("component_id")
        .agg(F.min(first).alias("first"))
        .select(F.col("first._row").alias("_row"))
    )
    return _without(rows, members.join(kept, "_row", "left_anti"), "copies")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the rows whose text holds a window of a benchmark item.

    Every row is judged by its own whole text, whatever its id; null and empty texts stay. An empty
    benchmark drops nothing. No rows give no rows.
    """
    _bound_batches(spark)
    rows = _numbered(docs)
    hits = decontamination.benchmark_hits(
        rows.select(F.col("_row").alias("doc_id"), "text"),
        spark.read.parquet(f"{sf_dir}/benchmark.parquet"),
    )
    return _without(rows, hits.where("n_hit > 0").select(F.col("doc_id").alias("_row")), "hit")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draw documents so that sources, languages and topics get their target weights.

    The draw goes by the id: rows of one id and cell, and all null ids of a cell, are drawn or left
    together. A null source or language is a value like others, null and empty texts weigh nothing
    and go by their cell. No rows give no rows.
    """
    drawn = mixed(_whole(docs, "doc_id", "text", "lang", "source"))
    return drawn.where("sampled").select("_doc.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and its slot in it.

    Shards differ by one row at most, and slots have no gaps. Rows are dealt to blocks by id and
    text, so null and repeated ids do not meet unless their texts are equal. No rows give no rows.
    """
    rows = _whole(docs, "doc_id", F.xxhash64("text").alias("_text"))
    sharded = sharding.shuffle_into_shards(rows, N_SHARDS, ("doc_id", "_text"))
    kept = [F.col("_doc")[c].alias(c) for c in docs.columns if c not in ("shard", "slot")]
    return sharded.select(*kept, "shard", "slot")


def _bound_batches(spark: SparkSession) -> None:
    """Bound what an executor and its Python workers hold of the texts on their way, by bytes.

    Spark's own limits are 10,000 rows or 64 MB, of which each task has several copies. It holds for
    the session from now on, since what a stage returns is run by its caller; no result depends on it.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def _whole(docs: DataFrame, *columns: str | Column) -> DataFrame:
    """Some columns, and all of them in one, so that no name clashes with what is added."""
    return docs.select(F.struct(*docs.columns).alias("_doc"), *columns)


def _numbered(docs: DataFrame) -> DataFrame:
    """The rows with a number each, by where they stand in the stored table they are read from.

    Ids may be null or repeated. Every read of a stored table makes the same splits of the same
    files, whatever columns are read, so a row has one number throughout a stage.
    """
    return _whole(docs, "doc_id", "text").withColumn("_row", F.monotonically_increasing_id())


def _without(rows: DataFrame, dropped: DataFrame, label: str) -> DataFrame:
    """The documents of all rows but the dropped ones."""
    numbers = stored(dropped.select("_row"), label)
    return without(rows.select("_row", "_doc"), numbers, ["_row"]).select("_doc.*")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]
# Classifier and random shuffle cannot be said in SQL; tests hold the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


def queries():
    return {"pipeline": run}


def oracle_sql():
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
