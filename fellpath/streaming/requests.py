"""An extension: a stream of route requests, answered batch by batch with the batch plans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from ..model import RasterMeta, RouteConfig
from ..plans import routing as R


def serve(requests: DataFrame, pixels: DataFrame, meta: RasterMeta, config: RouteConfig, sink: Callable[[DataFrame, int], None], checkpoint: str, mask: DataFrame | None = None) -> StreamingQuery:
    """Route every request (origin, dest, r1, c1, r2, c2) of a stream; sink gets the results and the batch's number.

    A batch that is repeated after a failure has the same number, so that a sink that overwrites by number writes each route once.
    """

    def batch(rows: DataFrame, number: int) -> None:
        if not rows.isEmpty():
            sink(R.hierarchical(rows.select("origin", "dest", "r1", "c1", "r2", "c2").distinct(), pixels, meta, config, mask), number)

    return requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
