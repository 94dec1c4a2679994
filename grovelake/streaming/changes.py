"""Store changes and content buffers as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import chunks
from ..operators.edit import tree_modify


def sync_changes(changes: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Apply a stream of changes (path, op, size, executable, target_id, seq) to a table of files, a micro-batch at a time.

    Of the changes to a path in one batch the last by seq holds. A batch that is run again after a failure gives the same
    table, as it sets and removes the same paths.
    """

    def each(batch: DataFrame, _: int) -> None:
        rest = [c for c in batch.columns if c not in ("path", "seq")]
        last = batch.groupBy("path").agg(F.max_by(F.struct(*rest), "seq").alias("c")).select("path", "c.*")
        write(tree_modify(read(), last))

    return changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upload_sizes(buffers: DataFrame, late: str = "10 minutes", gap: str = "5 minutes") -> DataFrame:
    """key, window, size, chunk_sizes of uploads in a stream of buffers (key, ts, bytes): an upload ends with a gap.

    Late buffers are waited for until the watermark passes; the chunks are those of all bytes of the upload in a row.
    """
    sized = buffers.withWatermark("ts", late).select("key", "ts", F.length("bytes").alias("n"))
    totals = sized.groupBy("key", F.session_window("ts", gap).alias("window")).agg(F.sum("n").alias("size"))
    return totals.select("key", "window", "size", chunks.chunk_sizes(F.col("size")).alias("chunk_sizes"))
