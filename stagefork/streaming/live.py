"""Queries as a stream: every micro-batch runs as worlds of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.worlds import Retrieval


def serve(r: Retrieval, queries: DataFrame, path: str, checkpoint: str, first_stage: str = "union") -> StreamingQuery:
    """Ranks of streamed queries (query_id, query_text), appended to `path` batch by batch; runs until the source is read."""
    def rank(batch: DataFrame, _: int) -> None:
        r.run(r.plain(batch.dropDuplicates(["query_id"]), first_stage)).withColumnRenamed("world_id", "query_id").write.mode("append").parquet(path)

    r.postings  # noqa: B018 - made once, so that no batch goes over the documents for its terms
    return queries.writeStream.foreachBatch(rank).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
