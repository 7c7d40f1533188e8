"""A query over the kernels that look for shapes: sharpness by block, lines, bright blobs, moving regions, noise of flat blocks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.functions import image
from roadloom.plans.analysis import _GX, _GY, _IMG, _PX, _frames, _kernel, _n
from roadloom.plans.queries import query, r

BRIGHT, MOVED = 190, 120


def _shapes(img: np.ndarray) -> tuple:
    grid = image.sharpness_grid(img, 2, 2)
    lines, confidence = image.hough(img, image.full(img), least=90, stride=1)
    blobs = image.bright_blobs(img, BRIGHT, 1, 2)
    soft = (img // 16 + 100).astype(np.uint8)
    return grid[0], grid[1], grid[2], grid[3], lines, confidence, len(blobs), max((b["size"] for b in blobs), default=0), image.motion_regions(img[::-1].copy(), img, MOVED, 1, 3), image.flat_noise(soft, None, 4)


def _regions(name: str, on: str, least: int) -> str:
    """WITH-clauses: <name> has the number of 8-connected regions of at least so many pixels, and the size of the largest, for each image."""
    return f"""{name}_on AS (SELECT vec_id, y, x FROM px WHERE {on}),
{name}_reach AS (SELECT vec_id, y, x, y AS ty, x AS tx FROM {name}_on
  UNION SELECT a.vec_id, a.y, a.x, b.y, b.x FROM {name}_reach a JOIN {name}_on b ON a.vec_id = b.vec_id AND abs(a.ty - b.y) <= 1 AND abs(a.tx - b.x) <= 1),
{name}_size AS (SELECT vec_id, first, count(*) AS n FROM (SELECT vec_id, y, x, min(ty * 8 + tx) AS first FROM {name}_reach GROUP BY vec_id, y, x) GROUP BY vec_id, first),
{name} AS (SELECT vec_id, count(*) AS n, max(n) AS largest FROM {name}_size WHERE n >= {least} GROUP BY vec_id)"""


_SOFT_GX = _GX.replace("p[", "q[")
_SOFT_GY = _GY.replace("p[", "q[")


@query(f"""WITH RECURSIVE {_IMG}, {_PX}, {_regions("bright", f"v >= {BRIGHT}", 2)}, {_regions("moved", f"abs(v - p[(7 - y) * 8 + x + 1]) >= {MOVED}", 3)},
lap AS (SELECT vec_id, (y // 4) * 2 + x // 4 AS block, {_n(0, -1)} + {_n(0, 1)} + {_n(-1, 0)} + {_n(1, 0)} - 4 * {_n(0, 0)} AS lap FROM i, range(1, 7) a(y), range(1, 7) b(x)),
sharp AS (SELECT vec_id, block, var_pop(lap) AS v FROM lap GROUP BY ALL),
g AS (SELECT vec_id, max(v) FILTER (WHERE block = 0) AS b0, max(v) FILTER (WHERE block = 1) AS b1, max(v) FILTER (WHERE block = 2) AS b2, max(v) FILTER (WHERE block = 3) AS b3 FROM sharp GROUP BY vec_id),
votes AS (SELECT vec_id, t, trunc(cos(radians(t)) * x + sin(radians(t)) * y) AS rho, count(*) AS n FROM i, range(1, 7) a(y), range(1, 7) b(x), range(40, 141, 5) c(t)
  WHERE ({_n(0, 1)} - {_n(0, -1)}) ** 2 + ({_n(1, 0)} - {_n(-1, 0)}) ** 2 >= 8100 GROUP BY ALL),
tops AS (SELECT vec_id, max(n) AS top FROM votes GROUP BY vec_id),
h AS (SELECT vec_id, least(count(*) FILTER (WHERE n >= greatest(8, CAST(floor(top * 0.6::DOUBLE) AS INTEGER))), 12) AS lines, least(1, any_value(top) / 8.0::DOUBLE) AS confidence FROM votes JOIN tops USING (vec_id) GROUP BY vec_id),
s AS (SELECT vec_id, list_transform(p, lambda v: v // 16 + 100) AS q FROM i),
e AS (SELECT vec_id, any_value(q) AS q, avg(sqrt(({_SOFT_GX}) ** 2 + ({_SOFT_GY}) ** 2)) / 255 AS energy FROM s, range(1, 4, 2) a(y), range(1, 4, 2) b(x) GROUP BY vec_id),
d AS (SELECT vec_id, q[y * 8 + x + 1] - ({' + '.join(_n(dy, dx).replace('p[', 'q[') for dy in (-1, 0, 1) for dx in (-1, 0, 1))}) / 9.0::DOUBLE AS off FROM e, range(1, 3) a(y), range(1, 3) b(x) WHERE energy < 0.06::DOUBLE),
z AS (SELECT vec_id, least(sqrt(avg(off * off)) / 18, 1) AS noise FROM d GROUP BY vec_id)
SELECT i.vec_id, round(b0, 6) AS b0, round(b1, 6) AS b1, round(b2, 6) AS b2, round(b3, 6) AS b3, coalesce(lines, 0) AS lines, round(coalesce(confidence, 0), 9) AS confidence,
  coalesce(bright.n, 0) AS blobs, coalesce(bright.largest, 0) AS largest, coalesce(moved.n, 0) AS moving, round(coalesce(noise, 0), 9) AS noise
FROM i JOIN g USING (vec_id) LEFT JOIN h USING (vec_id) LEFT JOIN bright USING (vec_id) LEFT JOIN moved USING (vec_id) LEFT JOIN z USING (vec_id)""")
def image_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _kernel("b0 double, b1 double, b2 double, b3 double, lines long, confidence double, blobs long, largest long, moving long, noise double", _shapes)
    t = _frames(spark, sf_dir).select("vec_id", f("p").alias("s"))
    return t.select("vec_id", *[r(F.col(f"s.b{i}"), 6).alias(f"b{i}") for i in range(4)], "s.lines", r(F.col("s.confidence"), 9).alias("confidence"), "s.blobs", "s.largest", "s.moving", r(F.col("s.noise"), 9).alias("noise"))
