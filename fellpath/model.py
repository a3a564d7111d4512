"""Metadata, parameters and table schemas of the routing engine."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class RasterMeta:
    """Affine transform (a, b, c, d, e, f), size, nodata and CRS of a raster; x = a*col + b*row + c, y = d*col + e*row + f."""

    transform: tuple[float, float, float, float, float, float]
    height: int
    width: int
    nodata: float | None = None
    crs: str | None = None

    @property
    def res(self) -> tuple[float, float]:
        """Pixel width and height, both positive."""
        return abs(self.transform[0]), abs(self.transform[4])

    def scaled(self, factor: int) -> RasterMeta:
        """The raster resampled by a whole factor: pixel sizes times the factor, floor of the size, same origin."""
        a, b, c, d, e, f = self.transform
        return RasterMeta((a * factor, b * factor, c, d * factor, e * factor, f), self.height // factor, self.width // factor, self.nodata, self.crs)


@dataclass(frozen=True)
class RouteConfig:
    """Parameters of a routing run.

    mode: 'exact' (the true minimum, ties by smallest direction code) or 'astar' (pops in the order of an A* search with
    ``weight`` times the heuristic; the same cost if all passable costs are at least 1 and weight is at most 1).
    policy: what happens to points outside the mask polygon: 'ignore', 'abort' or 'skip'.
    """

    origin: int = 5
    id_field: str = "id"
    factors: tuple[int, ...] = (32, 20, 10)
    buffer: int = 150
    weight: float = 1.0
    mode: str = "exact"
    policy: str = "ignore"
    heuristic: str = "anisotropic"
    plan_b: bool = True
    #: Cells that one search in a task may hold (some 300 bytes each); larger searches run tiled, and always exactly.
    kernel_cells: int = 500_000
    tile: int = 256


@dataclass
class RouteError(Exception):
    """A run that must stop: a missing layer, different CRSs, points outside the mask under the policy 'abort'."""

    reason: str
    ids: list[int] = field(default_factory=list)

    def __str__(self) -> str:
        return self.reason + (": " + ", ".join(map(str, self.ids)) if self.ids else "")


#: Schemas of the tables, as Spark reads them from text.
RASTER_META = "a double, b double, c double, d double, e double, f double, res_x double, res_y double, nodata double, crs string, height int, width int"
PIXELS = "row int, col int, cost double"
POINTS = "id int, ord int, x double, y double"
POLYGON_EDGES = "poly_id int, x1 double, y1 double, x2 double, y2 double"
DIST = "src int, row int, col int, g double"
ROUTE_CELLS = "route_id string, seq int, row int, col int"
ROUTES = "session_id string, id string, phase string, origin int, dest int, n int, cost double, geom array<struct<x:double,y:double>>, wkt string"
ROUTE_STATUS = "session_id string, origin int, dest int, status string, factor int, plan_b boolean, error string"
