"""Catchments and drawn terrain of rivers, each from the mosaic of its own box, one river to a task.

A river that fails says so in its ``error``, and the others go on.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillway.functions.geo import numbered_points
from rillway.operators.mosaic import met, mosaic
from rillway.operators.watershed import too_narrow
from rillway.sources import basemap

_POINT = "struct<lon:double,lat:double>"
RESULT = f"river_id string, source string, area_km2 double, n_cells long, frac double, offset_m double, threshold int, n_tried int, moved_cells double, raised double, snap_lon double, snap_lat double, ring array<{_POINT}>, note string, error string"
#: Fixed value: the share of its course that a catchment should hold.
WARN_BELOW = 0.9
#: Cells around a catchment's box that its drawing takes.
MARGIN_CELLS = 8


def delineate(cells: DataFrame, frames: DataFrame, tries: DataFrame, lines: DataFrame, boxes: DataFrame, accept: float = 0.9) -> DataFrame:
    """The best catchment of each river of ``boxes`` (``RESULT``): ``source`` is ``dem``, or ``undetermined`` where no pour point is accepted.

    ``cells``: ``tile``, ``r``, ``c``, ``z``. ``frames``: as in ``mosaic``. ``tries``: ``river_id``, ``seq``,
    ``offset_m``, ``threshold``, ``lon``, ``lat``. ``lines``: ``river_id``, ``line``, the river's own course.
    ``boxes``: ``river_id``, ``west``, ``south``, ``east``, ``north``. A river's terrain is that of its box,
    over however many tiles; what its task holds is that and its course. ``note`` says why a
    river is undetermined, and that an accepted catchment holds less than ``WARN_BELOW`` of its course.
    """
    thin = boxes.withColumn("_narrow", too_narrow(F.col("west"), F.col("south"), F.col("east"), F.col("north")))
    wide = thin.filter("not _narrow").withColumnRenamed("river_id", "key")
    own = mosaic(wide, cells, frames, whole=True).withColumnRenamed("key", "of")
    # A river's course, its pour points and its cell's size join as one row, of its own lines only.
    course = lines.groupBy("river_id").agg(numbered_points(F.sort_array(F.collect_list("line"))).alias("_lines"))
    points = tries.groupBy("river_id").agg(F.sort_array(F.collect_list(F.struct("seq", "offset_m", "threshold", "lon", "lat"))).alias("_tries"))
    size = frames.agg(F.min("cell").alias("cell"))
    asked = thin.join(points, "river_id", "left").join(course, "river_id", "left").join(F.broadcast(size)).select("river_id", "_narrow", "cell", "_tries", "_lines")

    def run(part: pd.DataFrame, todo: pd.DataFrame) -> pd.DataFrame:
        from rillway.functions import delineation, kernels

        columns = [f.split()[0] for f in RESULT.replace(_POINT, "p").split(", ")]
        if todo.empty:
            return pd.DataFrame(columns=columns)
        f = todo.iloc[0]
        out = dict.fromkeys(columns) | {"river_id": f["river_id"], "source": "undetermined"}
        try:
            if f["_narrow"]:
                out["note"] = "box too narrow"
            elif part.empty:
                out["error"] = "no cells"
            else:
                grid, r0, c0 = kernels.to_grid(part.r.to_numpy(), part.c.to_numpy(), part.z.to_numpy())
                tile = delineation.condition(grid)
                lines = kernels.parts(f["_lines"])
                tried = [(p["offset_m"], p["threshold"], p["lon"], p["lat"]) for p in f["_tries"]] if f["_tries"] is not None else []
                found = delineation.search(tile, tried, lines, c0 * f["cell"], -r0 * f["cell"], f["cell"], accept)
                if found is None:
                    out["note"] = "no pour point accepted"
                else:
                    ring = [{"lon": float(x), "lat": float(y)} for x, y in found.pop("ring")]
                    out |= found | {"source": "dem", "ring": ring}
                    if found["frac"] < WARN_BELOW:
                        out["note"] = f"holds {found['frac']:.0%} of its course"
        except Exception as e:
            out["error"] = f"{type(e).__name__}: {e}"
        return pd.DataFrame([out]).astype({"n_cells": "Int64", "threshold": "Int32", "n_tried": "Int32"})

    return own.groupBy("of").cogroup(asked.groupBy("river_id")).applyInPandas(run, RESULT)


def payloads(cells: DataFrame, frames: DataFrame, rivers: DataFrame, streams: DataFrame, exaggeration: float = 1.0, pixels: DataFrame | None = None, zoom: int = 0) -> DataFrame:
    """``river_id``, ``payload`` (JSON) and ``error``: the drawn terrain of each river, one river to a task.

    ``rivers``: ``river_id``, ``rings``, and the box of its terrain (``west``, ``south``, ``east``, ``north``), over
    whose heights colours and the height map run; without it, that is all of the tiles that the
    rings meet. ``streams``: ``river_id``, ``line``, of the whole catchment. A river's task takes the
    cells of its rings' box and a margin. With ``pixels`` (``basemap.read``), a river all of whose
    drawn cells have a colour at ``zoom`` has its ``basemap``, too.
    """
    every = F.flatten("rings")
    side = lambda f, k: f(F.transform(every, lambda p: p[k]))
    size = F.broadcast(frames.agg(F.min("cell").alias("cell")))
    drawn = rivers.select("river_id", "rings").join(size)
    pad = MARGIN_CELLS * F.col("cell")
    near = drawn.select(F.col("river_id").alias("key"), (side(F.array_min, "lon") - pad).alias("west"), (side(F.array_min, "lat") - pad).alias("south"), (side(F.array_max, "lon") + pad).alias("east"), (side(F.array_max, "lat") + pad).alias("north"))
    own = mosaic(near, cells, frames, whole=True).withColumnRenamed("key", "river_id")
    if pixels is not None:
        middle = own.join(size).select("river_id", "r", "c", ((F.col("c") + 0.5) * F.col("cell")).alias("lon"), (-(F.col("r") + 0.5) * F.col("cell")).alias("lat"))
        own = own.join(basemap.coloured(middle, pixels, zoom, ["river_id", "r", "c"]), ["river_id", "r", "c"], "left")
    if "west" in rivers.columns:
        whole = mosaic(rivers.select(F.col("river_id").alias("key"), "west", "south", "east", "north"), cells, frames)
        ends = whole.groupBy(F.col("key").alias("river_id")).agg(F.min("z").alias("lo"), F.max("z").alias("hi"))
    else:
        tile = cells.filter("z is not null and not isnan(z)").groupBy("tile").agg(F.min("z").alias("lo"), F.max("z").alias("hi"))
        ends = met(near, frames).join(tile, "tile").groupBy(F.col("key").alias("river_id")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    course = streams.groupBy("river_id").agg(numbered_points(F.sort_array(F.collect_list("line"))).alias("_lines"))
    # Under another name, as the cells' side comes from the same rivers.
    facts = drawn.join(course, "river_id", "left").join(ends, "river_id", "left").select(F.col("river_id").alias("of"), numbered_points(F.col("rings")).alias("rings"), "_lines", "cell", "lo", "hi")

    def run(part: pd.DataFrame, fact: pd.DataFrame) -> pd.DataFrame:
        from rillway.functions import kernels, terrain

        if fact.empty:
            return pd.DataFrame({"river_id": [], "payload": [], "error": []})
        f = fact.iloc[0]
        try:
            if part.empty:
                raise ValueError("no cells")
            grid, r0, c0 = kernels.to_grid(part.r.to_numpy(), part.c.to_numpy(), part.z.to_numpy())
            colours = np.stack([kernels.to_grid(part.r.to_numpy(), part.c.to_numpy(), part[k].to_numpy(dtype=float))[0] for k in ("red", "green", "blue")], axis=2) if "red" in part else None
            made = terrain.payload(grid, kernels.parts(f["rings"]), kernels.parts(f["_lines"]), c0 * f["cell"], -r0 * f["cell"], f["cell"], (f["lo"], f["hi"]), exaggeration, colours)
            return pd.DataFrame({"river_id": [f["of"]], "payload": [json.dumps(made)], "error": [None]})
        except Exception as e:
            return pd.DataFrame({"river_id": [f["of"]], "payload": [None], "error": [f"{type(e).__name__}: {e}"]})

    return own.groupBy("river_id").cogroup(facts.groupBy("of")).applyInPandas(run, "river_id string, payload string, error string")


def shaded_relief(tiles: DataFrame, cell_m: float, azimuth: float = 315.0, altitude: float = 45.0) -> DataFrame:
    """``tile``, ``r``, ``c`` with hillshade, slope, core and cast shadow for any sun, one tile to a task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        from rillway.functions import kernels, terrain

        grid, r0, c0 = kernels.to_grid(pdf.r.to_numpy(), pdf.c.to_numpy(), pdf.z.to_numpy())
        lit = terrain.shaded(grid, cell_m, cell_m, azimuth, altitude)
        r, c = pdf.r.to_numpy() - r0, pdf.c.to_numpy() - c0
        return pd.DataFrame({"tile": pdf.tile, "r": pdf.r, "c": pdf.c} | {k: v[r, c] for k, v in lit.items()})

    return tiles.select("tile", "r", "c", "z").groupBy("tile").applyInPandas(run, "tile string, r int, c int, hillshade double, slope double, core boolean, cast boolean")
