"""A stream of batches of frames through the factorisation, with its state in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glimmer.options import Options
from glimmer.plans import updates


def demix_stream(pixels: DataFrame, height: int, path: str, options: Options | None = None, sigma: float | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Starts a stream of (batch, pix, r, c, y) that takes each batch of frames into the state under path.

    Batches must come in the order of their numbers, each whole within a micro-batch (a file or folder of its own, with
    maxFilesPerTrigger, or one commit of a table). A micro-batch that comes again, because the stream stopped before it
    was committed, finds its batch marked as done and changes nothing; one that stopped half way is written anew from
    the state of the batch before. updates.batch_results reads the results at any time.
    """

    def take(rows: DataFrame, _: int) -> None:
        rows = rows.persist()
        try:
            for r in rows.select("batch").distinct().orderBy("batch").collect():  # the numbers of a micro-batch's batches
                updates.demix_batch(rows.where(F.col("batch") == r["batch"]), r["batch"], height, path, options, sigma)
        finally:
            rows.unpersist()

    writer = pixels.writeStream.foreachBatch(take).option("checkpointLocation", f"{path.rstrip('/')}/stream")
    return writer.trigger(**(trigger or {"availableNow": True})).start()
