"""From files to what a viewer asks for: one call resolves a field and its grid, another shows it."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from ..codec.bits import FormatError
from ..sources import files as S
from ..sources import grids
from . import field, render


def resolve(files: DataFrame, message: int | None = None, variable: str | None = None, y: str | None = None, x: str | None = None, at: dict[str, int] | None = None) -> tuple[DataFrame, object]:
    """(j, i, value) and the grid of a message of a GRIB file, or of a slice of a NetCDF variable.

    ``files`` holds one file (path, content).  The grid is a ``Source`` where the field can
    be painted but not warped.
    """
    if variable is not None:
        return grids.slice_field(files, variable, y, x, at or {})
    if message is None:
        raise ValueError("name a message or a variable")
    rows = S.found(files, message).take(2)
    if len(rows) != 1:
        raise ValueError("a message is of one file")
    if rows[0].error:
        raise FormatError(rows[0].error)
    grid = grids.message_grid(json.loads(rows[0].meta)["grid"])
    return S.cells(files, message), grid or grids.Source(rows[0].ni, rows[0].nj)


def combined(a: tuple[DataFrame, object], b: tuple[DataFrame, object], op: str) -> tuple[DataFrame, object]:
    """Two resolved fields cell by cell; their grids must be equal in every part."""
    if a[1] != b[1]:
        raise ValueError("the fields are not on the same grid")
    return field.combine(a[0], b[0], op).select("j", "i", "value"), a[1]


def picture(resolved: tuple[DataFrame, object], projection: str = "source", **options) -> DataFrame:
    """(px, py, r, g, b, a) of a resolved or combined field."""
    if projection != "source" and isinstance(resolved[1], grids.Source):
        raise ValueError("this grid cannot be warped; render its source")
    return render.render(*resolved, projection, **options)


def probed(resolved: tuple[DataFrame, object], points: DataFrame, target=None, flip: bool = False) -> DataFrame:
    return render.probe(*resolved, points, target, flip)


def contoured(resolved: tuple[DataFrame, object], levels: list[float] | None = None, count: int = 8) -> DataFrame:
    """Located contour lines of a resolved or combined field, at given or nice levels."""
    f, grid = resolved
    if levels is None:
        ends = field.value_range(f).first()
        levels = render.nice_levels(ends.lo, ends.hi, count) if ends.lo is not None else []
    rows = f.sparkSession.createDataFrame([(float(v),) for v in levels], "level double")
    return render.contour_lines(render.contours(f, rows), grid)
