"""Reads as a stream: each micro-batch is aligned against the static reference by itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.policy import report
from ..operators.search import align
from ..options import AlignOptions

READS = "read_id long, mate int, name string, seq string, qual string, raw string, trimmed5 int, trimmed3 int"


def align_stream(reads: DataFrame, refs: DataFrame, opts: AlignOptions, sink: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """reads is a stream of READS. sink gets the reported placements of each batch with its number, which makes it idempotent on a restart."""

    def one(batch: DataFrame, number: int) -> None:
        sink(report(align(batch, refs, opts), opts), number)

    return reads.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
