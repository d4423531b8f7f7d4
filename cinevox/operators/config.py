"""Detector configuration: sizes, classes, and their file forms."""

from __future__ import annotations

import ast
import json
import math
from collections.abc import Sequence
from dataclasses import asdict, dataclass, fields


# Keys of the older text form, and the fields they set.
LEGACY_KEYS = {
    "nb_events_category": "ncat",
    "events_category_names": "catnames",
    "window_half_size": "half_size",
    "nb_temporal_frames": "nframes",
    "cell_diameter": "cell_diameter",
    "extrusion_duration": "extrusion_duration",
    "neuralnetwork_nb_filters": "nb_filters",
    "neuralnetwork_batch_size": "batch_size",
    "neuralnetwork_nb_epochs": "nb_epochs",
    "datatraining_augmentation": "augmentation",
    "datatraining_addnothingwindows": "add_nothing_windows",
}


# The names of the fields and their defaults are those of the configuration files.
@dataclass(frozen=True)
class Config:
    """Half window, frames before and after the centre, typical object, classes (class 0, nothing, has an empty suffix) and training options."""

    half_size: tuple[int, int] = (22, 22)
    nframes: tuple[int, int] = (5, 5)
    cell_diameter: float = 25.0
    extrusion_duration: float = 4.5
    ncat: int = 4
    catnames: tuple[str, ...] = ("", "_cell_death.zip", "_cell_sop.zip", "_cell_division.zip")
    nb_filters: int = 8
    batch_size: int = 30
    nb_epochs: int | None = None
    augmentation: int | None = None
    add_nothing_windows: int | None = None

    def __post_init__(self):
        if len(self.catnames) < self.ncat:
            raise ValueError(f"{self.ncat} classes need as many names")

    @property
    def window_shape(self) -> tuple[int, int, int]:
        return sum(self.nframes), 2 * self.half_size[0] + 1, 2 * self.half_size[1] + 1

    @property
    def bounds(self) -> tuple[int, int, int, int]:
        """Frames before (inclusive) and after (exclusive) the centre, and rows and columns on either side, that get a window's probability."""
        return math.floor(0.2 * self.nframes[0]), math.floor(0.2 * self.nframes[1]) + 1, math.floor(0.3 * self.half_size[0]), math.floor(0.3 * self.half_size[1])

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Config:
        known = {f.name for f in fields(cls)}
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(text).items() if k in known})

    @classmethod
    def from_legacy(cls, text: str) -> Config:
        """From ``key = value`` lines; comments and unknown keys are ignored."""
        values = {}
        for line in text.splitlines():
            key, found, value = line.partition("#")[0].partition("=")
            if found and key.strip() in LEGACY_KEYS:
                got = ast.literal_eval(value.strip())
                values[LEGACY_KEYS[key.strip()]] = tuple(got) if isinstance(got, list) else got
        return cls(**values)

    def compatible(self, other: Config) -> bool:
        """Whether networks of both can form an ensemble."""
        return (self.ncat, self.nframes, self.half_size) == (other.ncat, other.nframes, other.half_size)


def extend_catnames(old: Sequence[str], new: Sequence[str]) -> tuple[str, ...]:
    """The new names, which must start with the old ones and not repeat."""
    if tuple(new[: len(old)]) != tuple(old):
        raise ValueError("the old classes come first, in their order")
    if len(set(new)) != len(new):
        raise ValueError("a class is named twice")
    return tuple(new)


def parse_diameter(text: str) -> float | str:
    if text == "auto":
        return text
    try:
        value = float(text)
    except ValueError:
        value = 0.0
    if not (value > 0 and math.isfinite(value)):
        raise ValueError(f"{text!r} is neither a positive number nor 'auto'")
    return value


def parse_oversample(options: Sequence[str]) -> dict[str, int]:
    """``name=factor`` options; the name may contain ``=``."""
    out = {}
    for option in options:
        name, _, factor = option.rpartition("=")
        if not name or not factor.isdigit() or int(factor) < 1:
            raise ValueError(f"{option!r} is not name=factor with a factor from 1 on")
        out[name] = int(factor)
    return out


def parse_classes(options: Sequence[str]) -> dict[str, str]:
    """``name=suffix`` options; the suffix may contain ``=`` and ends in ``.zip``."""
    out = {}
    for option in options:
        name, _, suffix = option.partition("=")
        if not name or not suffix.endswith(".zip"):
            raise ValueError(f"{option!r} is not name=suffix with a suffix in .zip")
        out[name] = suffix
    return out
