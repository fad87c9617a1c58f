"""Options of the pattern pipeline."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum


class Matcher(Enum):
    RGB = "rgb"
    LAB = "lab"
    OKLAB = "oklab"


class Generator(Enum):
    STAGED = "staged"
    SUPERPIXEL = "gerstner"


class Resample(Enum):
    TRIANGLE = "triangle"
    NEAREST = "nearest"
    CATMULL_ROM = "catmull-rom"
    GAUSSIAN = "gaussian"
    LANCZOS3 = "lanczos3"


@dataclass(frozen=True)
class RenderOptions:
    cell_size: int = 10


@dataclass(frozen=True)
class GenerateOptions:
    width: int
    height: int
    resample: Resample = Resample.TRIANGLE
    matcher: Matcher = Matcher.OKLAB
    generator: Generator = Generator.STAGED
    max_colors: int | None = None
    despeckle: int | None = None
    render: RenderOptions = field(default_factory=RenderOptions)


#: Preferences of an interactive front end and their defaults.
SETTINGS = {"palette_id": "mard", "generator": "staged", "limit_colors": "false", "max_colors": "24", "despeckle_on": "false", "despeckle": "2", "width": "100", "border_rings": "0"}
