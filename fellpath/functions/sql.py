"""Table functions for SQL users."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="seq int, row int, col int, g double")
class RouteCells:
    """The cells of a least-cost path, from an array of (row, col, cost): no rows if there is none."""

    def eval(self, cells: list, r1: int, c1: int, r2: int, c2: int, dx: float, dy: float) -> Iterator[tuple]:
        from fellpath.operators.kernel import spread, trace_exact

        cost = {(x["row"], x["col"]): x["cost"] for x in cells or []}
        start, goal = (r1, c1), (r2, c2)
        if start not in cost:
            return
        g = spread(cost, {start: 0.0}, dx, dy, goal=goal)
        for k, (r, c) in enumerate(trace_exact(cost, g, start, goal, dx, dy) or []):
            yield k, r, c, g[r, c]


def register(spark: SparkSession) -> None:
    """Make the table functions known to a session: ``SELECT * FROM route_cells(cells, r1, c1, r2, c2, dx, dy)``."""
    spark.udtf.register("route_cells", RouteCells)
