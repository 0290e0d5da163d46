"""Appending to the log from a stream of attempts: retries dropped and offsets assigned across micro-batches.

Each micro-batch goes through the same operators as a batch job, so a hot producer or partition is split the
same way, and is published as one batch of the log, together with the state after it: one row per (partition,
producer), its last sequence and offset. A batch repeated after a failure finds itself published and does nothing.

The query's id is stored next to the log. A new query, whose batches begin at 0 again, is refused by a log that
another one has filled, instead of being taken for a repetition.
"""

from pyspark.sql import DataFrame

from tidemark.operators.append import append_to_log
from tidemark.session import folders, rename

_QUERY = "sql.streaming.queryId"  # Spark sets it for the jobs of a query


def _claim(spark, log_path: str, query: str) -> None:
    """Makes the log the query's own, or refuses it."""
    owners = [n.partition("-")[2] for n in folders(spark, log_path) if n.startswith("_query-")]
    if owners and owners != [query]:
        raise ValueError(f"the log {log_path} belongs to the streaming query {owners[0]}, not to {query}")
    if not owners:
        staged = f"{log_path}/_claim_{query}"
        spark.createDataFrame([(query,)], "query string").write.mode("overwrite").parquet(staged)
        rename(spark, staged, f"{log_path}/_query-{query}")


def append_handler(log_path: str, direct=False, query=None):
    """A ``foreachBatch`` handler that appends each micro-batch to the log exactly once.

    ``query`` names the writer where there is no streaming query, as in a replay by hand.
    """
    def handle(frame: DataFrame, batch_id: int):
        spark = frame.sparkSession
        own = spark.sparkContext.getLocalProperty(_QUERY) or query
        if own is None:
            raise ValueError("outside of a streaming query, the handler needs the name of the writer")
        _claim(spark, log_path, own)
        append_to_log(spark, frame, log_path, batch_id, direct)
    return handle
