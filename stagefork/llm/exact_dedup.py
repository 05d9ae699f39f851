"""Exact deduplication by a stateful stream over disk-backed keyed state.

A structured stream reads the table and keeps, for every digest of a normalised
text, one state row in RocksDB: the identifier of the row that stays, where its
content lies, and how many rows had the digest. There is no watermark, so no key
ever expires. The state is read back as a table, every row looks up its digest,
and the full bytes of each hit are compared with those of the row that stays.

Only DataFrame and SQL functions run; there is no Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import SPACE, discard, saved, scratch_path, table

#: RocksDB holds the state; it doesn't reserve disk ahead, since each partition of the state has its own files.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Hits that are compared with one copy of the text that stays.
HITS_PER_COPY = 1024


def normalised(text):
    """The text without white space; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for blank in SPACE:  # `translate` takes a text apart into characters
        out = F.replace(out, F.lit(blank), F.lit(""))
    return out


def digested(docs: DataFrame, id_col: str, text_col: str, digest=None) -> DataFrame:
    text = F.col(text_col)
    # Without `coalesce` a join on the digest filters rows by it first, which computes it twice.
    digest = digest or (lambda c: F.coalesce(F.sha2(c.cast("binary"), 256), F.lit("")))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        normalised(text).alias("norm"),
        F.coalesce(F.char_length(text), F.lit(0)).alias("n_points"),
    ).withColumn("digest", digest(F.col("norm")))


def stream_state(
    spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", digest=None,
    bytes_per_trigger: str | None = None,
) -> DataFrame:
    """digest, keep_id, locator, group_size for every digest in the table at `path`.

    Runs the stream to the end of what the folder holds now. Micro-batches can be
    bounded with `bytes_per_trigger`; the state after the last one is the same,
    since a longer or earlier row replaces the one that state holds.
    """
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", bytes_per_trigger)
    # A pattern that fits this path alone: a stream takes a single file only through one.
    rows = reader.parquet(f"{path[:-1]}[{path[-1]}]").select("*", F.col("_metadata.file_path").alias("_locator"))
    rows = digested(rows.withColumn("_id", F.struct(F.col(id_col).alias("id"), "_locator")), "_id", text_col, digest)
    # ~id falls as id rises and, unlike -id, can't overflow; a null id sorts last.
    first = F.struct("n_points", F.bitwise_not(F.col("doc_id.id")).alias("order"), F.col("doc_id._locator").alias("locator"))
    kept = rows.groupBy("digest").agg(F.max(first).alias("first"), F.count(F.lit(1)).alias("group_size"))
    checkpoint = scratch_path(spark, "exact-dedup-state")
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        run = (
            kept.writeStream.format("noop").outputMode("update").trigger(availableNow=True)
            .option("checkpointLocation", checkpoint).start()
        )
        run.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if run.lastProgress is None:  # an empty folder starts no batch, so there is no state
        return spark.createDataFrame([], "digest string, n_points int, keep_id long, locator string, group_size long")
    state = spark.read.format("statestore").load(checkpoint)
    value = state.schema["value"].dataType.names
    best, size = (F.col("value")[name] for name in value)
    return state.select(
        F.col("key.digest"), best["n_points"].alias("n_points"),
        F.bitwise_not(best["order"]).alias("keep_id"), best["locator"].alias("locator"), size.alias("group_size"),
    )


def unequal_hits(docs: DataFrame, state: DataFrame, id_col: str, text_col: str, digest=None) -> DataFrame:
    """Digests under which some row's bytes differ from those of the row that stays."""
    shared = state.where("group_size > 1").select(
        "digest", "keep_id", F.col("n_points").alias("keep_points"),
        F.ceil(F.col("group_size") / HITS_PER_COPY).cast("int").alias("copies"),
    )
    rows = digested(docs, id_col, text_col, digest).join(shared.hint("shuffle_hash"), "digest")
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("keep_points"))
    salt = F.pmod(F.xxhash64("doc_id"), F.col("copies")).cast("int")
    # Kept, since both sides of the comparison are made of it.
    rows = saved(rows.select("digest", "norm", "copies", salt.alias("salt"), stays.alias("stays")), "exact-dedup-hits")
    hits = rows.where("not stays").select("digest", "salt", "norm")
    copies = (
        rows.where("stays").groupBy("digest").agg(F.min("norm").alias("keep_norm"), F.max("copies").alias("copies"))
        .select("digest", "keep_norm", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"))
    )
    out = saved(hits.join(copies, ["digest", "salt"]).where("norm != keep_norm").select("digest").distinct(), "exact-dedup-clash")
    discard(rows)
    return out


def exact_dedup(
    spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", digest=None,
    bytes_per_trigger: str | None = None,
) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of the table at `path`.

    Of rows equal without white space, the one with the most code points stays,
    then the one with the smallest id; a null id comes last. A null text counts as
    empty, and empty texts are equal. Rows that repeat an id and a length are one
    document, so all or none of them are kept. An empty table gives no rows;
    further columns are not read. Should two texts share a digest, the rows under
    it are grouped again by their whole text.
    """
    state = stream_state(spark, path, id_col, text_col, digest, bytes_per_trigger)
    docs = spark.read.parquet(path)
    clash = unequal_hits(docs, state, id_col, text_col, digest)
    rows = digested(docs, id_col, text_col, digest)
    looked_up = rows.drop("norm").join(state.drop("locator").withColumnRenamed("n_points", "keep_points"), "digest")
    sha = F.col("digest")
    if digest is not None:
        looked_up = rows.withColumn("sha", F.sha2(F.col("norm").cast("binary"), 256)).drop("norm").join(
            state.drop("locator").withColumnRenamed("n_points", "keep_points"), "digest")
        sha = F.col("sha")
    if clash.isEmpty():
        return _result(looked_up, sha)
    again = rows.join(clash, "digest", "left_semi")
    same = Window.partitionBy("digest", "norm")
    first = F.max(F.struct("n_points", F.bitwise_not(F.col("doc_id")).alias("order"))).over(same)
    again = (
        again.withColumn("first", first).withColumn("group_size", F.count(F.lit(1)).over(same))
        .withColumn("keep_id", F.bitwise_not(F.col("first.order"))).withColumn("keep_points", F.col("first.n_points"))
    )
    return _result(looked_up.join(clash, "digest", "left_anti"), sha).unionByName(
        _result(again, F.sha2(F.col("norm").cast("binary"), 256)))


def _result(rows: DataFrame, sha) -> DataFrame:
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("keep_points"))
    return rows.select("doc_id", "keep_id", "group_size", kept.alias("kept"), sha.alias("text_sha256"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark, f"{sf_dir}/documents.parquet")


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""
