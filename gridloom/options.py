"""All tunables of the table engine in one immutable object."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Options:
    """Defaults give the documented behaviour; every operator takes what it needs from here."""

    dpi: int = 500
    blank_level: int = 250
    blank_fraction: float = 0.01
    page_block: int = 15
    cell_block: int = 11
    adaptive_c: float = 2.0
    denoise: str = "nlm"  # or "none"
    border_canny: tuple[int, int] = (50, 150)
    line_length: int = 40
    line_iterations: int = 2
    line_min_area: float = 100.0
    line_max_fraction: float = 0.5
    line_min_side: int = 10
    contour_min_fraction: float = 0.0001
    contour_max_fraction: float = 0.99
    min_side: int = 5
    overlap_limit: float = 0.7
    crop_padding: int = 3
    min_crop: int = 5
    minimum_confidence: float = 50.0
    high_confidence: float = 90.0
    #: Accepted and stored, without an effect: nothing rotates cells.
    rotation_confidence: float = 70.0
    #: Eight variants and six configurations per cell instead of three and two.
    verbose: bool = False
    grid_tolerance: int = 5
    span_factor: float = 0.3
    default_width: int = 100
    #: "reference" keeps the original span arithmetic, which counts a cell's own column twice;
    #: "geometric" gives the spans that the boxes cover.
    span_mode: str = "reference"
    #: "PERMISSIVE" puts errors in a column, "FAILFAST" raises them.
    mode: str = "PERMISSIVE"
    slow_seconds: float = 0.1
    log_batch: int = 100
    log_sample: int = 10


DEFAULTS = Options()
