"""Settings with their bounds, and the per-request overlay."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


class InvalidOption(ValueError):
    """A setting outside its bounds."""


# Defaults and bounds of the settings (least, most; None is open).
BOUNDS = {
    "target_dpi": (1, 2400), "max_image_dimension": (0, None), "max_decode_pixels": (0, None), "jpeg_quality": (0.0, 1.0), "min_dimension": (1, 10000),
    "min_byte_size": (0, None), "min_reduction_ratio": (0.0, 1.0), "parallelism": (0, None), "parallel_image_threshold": (0, None),
    "max_concurrent_compressions": (0, None), "max_active_jobs": (1, None), "retention_seconds": (1, None),
}
POLICIES, CACHES = ("KEEP_ORIGINAL", "USE_SMALLEST"), ("TEMP_FILE", "MEMORY")
PREFIX = "pdf.compression."
#: Settings whose property has another name than their own.
RENAMED = {"async.max-active-jobs": "max_active_jobs", "async.retention": "retention_seconds"}
UNITS = {"ms": 0.001, "s": 1, "m": 60, "h": 3600, "d": 86400}
OVERRIDES = ("target_dpi", "jpeg_quality", "max_image_dimension", "strip_metadata", "deduplicate_images")


@dataclass(frozen=True)
class Settings:
    target_dpi: int = 150
    max_image_dimension: int = 0
    max_decode_pixels: int = 500_000_000
    jpeg_quality: float = 0.75
    min_dimension: int = 16
    min_byte_size: int = 8192
    min_reduction_ratio: float = 0.10
    larger_result_policy: str = "KEEP_ORIGINAL"
    stream_cache: str = "TEMP_FILE"
    recompress_cmyk: bool = False
    parallelism: int = 0
    parallel_image_threshold: int = 2
    max_concurrent_compressions: int = 0
    deduplicate_images: bool = True
    strip_metadata: bool = False
    strip_private_data: bool = False
    log_composition: bool = True
    subset_fonts: bool = True
    max_active_jobs: int = 100
    retention_seconds: int = 3600

    def __post_init__(self):
        for f in fields(self):
            value = getattr(self, f.name)
            if f.name in BOUNDS:
                least, most = BOUNDS[f.name]
                if value is None or math.isnan(value) or value < least or (most is not None and value > most):
                    raise InvalidOption(f"{f.name} must be from {least} to {most}, not {value}")
        if self.larger_result_policy not in POLICIES or self.stream_cache not in CACHES:
            raise InvalidOption("unknown policy or cache")

    def overlay(self, **overrides) -> Settings:
        """A copy with the request's non-null overrides; only the five request options may be given."""
        if unknown := set(overrides) - set(OVERRIDES):
            raise InvalidOption(f"not a request option: {sorted(unknown)}")
        return replace(self, **{k: v for k, v in overrides.items() if v is not None})

    def slots(self, cores: int) -> int:
        return self.max_concurrent_compressions or cores * 4


def seconds(value: str) -> int:
    """A duration such as 30s, 5m, 1h, PT1H30M or a bare number of milliseconds."""
    if m := re.fullmatch(r"([+-]?\d+)\s*(ms|s|m|h|d)?", value.strip()):
        return int(int(m[1]) * UNITS[m[2] or "ms"])
    if m := re.fullmatch(r"(?i)P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?", value.strip()):
        return sum(int(x or 0) * u for x, u in zip(m.groups(), (86400, 3600, 60, 1), strict=True))
    raise InvalidOption(f"not a duration: {value}")


def typed(name: str, value: str):
    """A property's text as its setting's type."""
    kind = type(getattr(Settings(), name))
    try:
        if name == "retention_seconds":
            return seconds(value)
        if kind is bool:
            return {"true": True, "false": False}[value.strip().lower()]
        if kind is str:
            return value.strip().replace("-", "_").upper()
        return kind(value.strip())
    except (KeyError, ValueError) as e:
        raise InvalidOption(f"{name}: {value!r} is no {kind.__name__}") from e


def properties(text: str) -> dict[str, str]:
    """Lines of key=value; # and ! begin comments."""
    rows = (line.strip() for line in text.splitlines())
    return {k.strip(): v.strip() for k, _, v in (x.partition("=") for x in rows if x and x[0] not in "#!")}


def loaded(text: str = "", env: Mapping[str, str] | None = None, args: Sequence[str] = ()) -> Settings:
    """Settings from properties, then the environment, then arguments --key=value; later ones count. Keys are the settings'
    names with dashes behind the prefix, in the environment in capitals without dashes; other keys are passed over."""
    names = {f.name.replace("_", "-"): f.name for f in fields(Settings)} | RENAMED
    for own in RENAMED.values():
        names.pop(own.replace("_", "-"), None)
    given = properties(text)
    by_env = {re.sub("[^A-Z0-9]", "_", (PREFIX + k).upper().replace("-", "")): PREFIX + k for k in names}
    given |= {by_env[k]: v for k, v in (env or {}).items() if k in by_env}
    given |= {k: v for k, _, v in (x[2:].partition("=") for x in args if x.startswith("--"))}
    return Settings(**{names[k.removeprefix(PREFIX)]: typed(names[k.removeprefix(PREFIX)], v) for k, v in given.items() if k.startswith(PREFIX) and k.removeprefix(PREFIX) in names})


def overlaid(name: str, override: Column, settings: Settings) -> Column:
    """The row's override or the setting; a row outside the bounds raises."""
    value = F.coalesce(override, F.lit(getattr(settings, name)))
    least, most = BOUNDS.get(name, (None, None))
    ok = F.lit(True)
    if least is not None:
        ok = ok & (value >= least)
    if most is not None:
        ok = ok & (value <= most)
    return F.when(F.assert_true(ok, F.lit(f"{name} out of bounds")).isNull(), value)
