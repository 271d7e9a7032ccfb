"""The engine's functions under SQL names: scalar functions, and table functions for raster operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from gridloom.functions import kernels as K
from gridloom.functions.text import COURSES, WHITE_SPACE
from gridloom.operators import raster

_WORD = (
    "CASE WHEN w RLIKE '^[I1l]$' THEN 'I' WHEN w RLIKE '^[I1l]+$' THEN repeat('1', length(w)) "
    f"WHEN w RLIKE '{'|'.join(COURSES)}' THEN translate(w, 'I', '1') ELSE w END"
)
_SPLIT = WHITE_SPACE.replace("\\", "\\\\")
# Bodies of the SQL functions; the Column forms in gridloom.functions.text say the same.
SCALARS = {
    "repair_text(t STRING) RETURNS STRING": f"CASE WHEN t = '' THEN t ELSE array_join(transform(filter(split(replace(t, '|', 'I'), '{_SPLIT}'), w -> w <> ''), w -> {_WORD}), ' ') END",
    "file_type(path STRING) RETURNS STRING": "CASE WHEN endswith(lower(path), '.pdf') THEN 'pdf' ELSE 'image' END",
    "message_pattern(m STRING) RETURNS STRING": "CASE WHEN contains(m, ':') THEN substring_index(m, ':', 1) ELSE substring(m, 1, 50) END",
}


def _image(height: int, width: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(height, width)


@udtf(returnType="method string, height int, width int, data binary")
class CellVariants:
    """The default variants of a grey cell image, in order."""

    def eval(self, height: int, width: int, data: bytes) -> Iterator[tuple]:
        for name, image in raster.variants(_image(height, width, data)):
            yield name, image.shape[0], image.shape[1], image.tobytes()


@udtf(returnType="i int, x1 int, y1 int, x2 int, y2 int, area double")
class Contours:
    """Boxes and areas of the contours of a binary image; `external` leaves out inner ones."""

    def eval(self, height: int, width: int, data: bytes, external: bool) -> Iterator[tuple]:
        for i, points in enumerate(K.contours(_image(height, width, data), external)):
            x, y, w, h = K.bounds(points)
            yield i, x, y, x + w, y + h, K.area(points)


@udtf(returnType="method string, x1 int, y1 int, x2 int, y2 int")
class CellCandidates:
    """Cell candidates of a grey table image by both methods, in order."""

    def eval(self, height: int, width: int, data: bytes) -> Iterator[tuple]:
        grey = _image(height, width, data)
        for method, found in (("lines", raster.line_candidates(grey)), ("contours", raster.contour_candidates(grey))):
            for x, y, w, h in found:
                yield method, x, y, x + w, y + h


def register(spark: SparkSession) -> None:
    """Make the functions known to a session's SQL."""
    for head, body in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    for name, function in (("cell_variants", CellVariants), ("contours", Contours), ("cell_candidates", CellCandidates)):
        spark.udtf.register(name, function)
