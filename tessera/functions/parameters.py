"""Parameters that are part of keys: aliases, labels and content hashes. They gate plans, not data."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import asdict, dataclass
from datetime import datetime

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted spellings of each choice.
CHOICES = {
    "peak_metric": {"rms": "rms", "spatial-std": "spatial-std", "spatial-stddev": "spatial-std", "std": "spatial-std"},
    "normalization": {"zscore": "zscore", "z": "zscore", "robust-zscore": "robust-zscore", "robust": "robust-zscore", "mad-zscore": "robust-zscore"},
    "global_metric": {"rms": "rms", "envelope-rms": "envelope-rms", "envelope": "envelope-rms", "env-rms": "envelope-rms", "spatial-std": "spatial-std", "spatial-stddev": "spatial-std", "std": "spatial-std"},
    "weighting": {"equal": "equal", "sqrt-channel-count": "sqrt-channel-count", "sqrt-channels": "sqrt-channel-count", "sqrt": "sqrt-channel-count"},
    "connectivity": {"corr": "corr", "correlation": "corr", "pearson": "corr", "plv": "plv", "phase-locking-value": "plv", "wpli": "wpli", "weighted-phase-lag-index": "wpli"},
    "backend": {"pca-kmeans": "pca-kmeans", "pca": "pca-kmeans"},
    "archetype_space": {"yeo17": "yeo17", "yeo-17": "yeo17", "aal3": "aal3", "aal-3": "aal3", "aal": "aal3"},
}


def choice(kind: str, value: str) -> str:
    """The canonical spelling: trimmed, lower case, underscores as hyphens; an unknown one raises ValueError."""
    known = CHOICES[kind]
    text = value.strip().lower().replace("_", "-")
    if text not in known:
        raise ValueError(f"{kind}: {value!r} is none of {sorted(set(known.values()))}")
    return known[text]


def metric_label(metric: str, weighting: str) -> str:
    return f"{choice('global_metric', metric)}__{choice('weighting', weighting)}"


def branch_name(text: str) -> str:
    """Lower case with runs of other characters than letters and digits as underscores."""
    return re.sub(r"[^a-z0-9]+", "_", text.lower()).strip("_")


def content_hash(value: object, digits: int = 10) -> str:
    """Hash of a value's JSON with sorted keys: equal parameters give equal names."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, default=str).encode()).hexdigest()[:digits]


def run_id(now: datetime | None = None) -> str:
    """A run's name: its date and time."""
    return (now or datetime.now()).strftime("%Y%m%d_%H%M%S")


def without_suffix(label: Column) -> Column:
    """A label without a trailing number (`_3`) or side (` L`, ` R`)."""
    return F.regexp_replace(F.regexp_replace(label, r" [LR]$", ""), r"_\d+$", "")


def coordinates(text: Column) -> Column:
    """The struct (x, y, z) of a text like [1.5, 2, -3]; a part that is no number is null."""
    parts = F.split(F.regexp_replace(text, r"[\[\]\s]", ""), ",")
    return F.struct(*(F.get(parts, F.lit(i)).try_cast("double").alias(name) for i, name in enumerate("xyz")))


def shown_number(value: Column, digits: int = 3) -> Column:
    """A number as text with so many decimals, rounded by its exact binary value as in C (Java's formats round its shortest text, half up); null: NA."""

    @F.pandas_udf("string")
    def show(values: pd.Series) -> pd.Series:
        return values.map(lambda v: f"{v:.{digits}f}")

    return F.when(value.isNull(), F.lit("NA")).otherwise(show(value.cast("double")))


def shown_p(value: Column, digits: int = 3) -> Column:
    """A probability as text; under the least shown value `<` that value; null: NA."""
    least = 10.0**-digits
    return F.when(value < least, F.lit(f"<{least:.{digits}f}")).otherwise(shown_number(value, digits))


@dataclass(frozen=True)
class FieldKey:
    """Parameters that most field-state tables carry as columns."""

    peak_metric: str = "rms"
    normalization: str = "zscore"
    n_states: int = 4
    min_duration_ms: int = 30

    def __post_init__(self) -> None:
        object.__setattr__(self, "peak_metric", choice("peak_metric", self.peak_metric))
        object.__setattr__(self, "normalization", choice("normalization", self.normalization))

    def add_to(self, df):
        """The table with the parameters as columns."""
        return df.withColumns({name: F.lit(value) for name, value in asdict(self).items()})


@dataclass(frozen=True)
class RunConfig:
    """What a run depends on; ``key`` names its cached tables and leaves out where and when it runs."""

    analysis_state: str = "IDE_A"
    low_hz: float = 1.0
    high_hz: float = 40.0
    sample_rate: float = 250.0
    parcellation: str = "aal3"
    min_subjects: int = 7
    seed: int = 42
    tolerance_ms: float = 5.0
    field: FieldKey = FieldKey()

    @property
    def key(self) -> str:
        return content_hash(asdict(self))
