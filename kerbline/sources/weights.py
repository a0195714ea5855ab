"""Model checkpoints as NumPy archives: weights, feature names and the fitted scaler."""

from __future__ import annotations

import io
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import SparkSession


@dataclass
class Checkpoint:
    """``config`` has the numbers of inputs, hidden units and layers; ``scaler`` maps a column to its quantiles."""

    weights: dict[str, np.ndarray]
    features: list[str]
    config: dict[str, float]
    scaler: dict[str, list[float]] = field(default_factory=dict)


def dump(model: Checkpoint) -> bytes:
    out = io.BytesIO()
    named = {f"w/{k}": v for k, v in model.weights.items()} | {f"q/{k}": np.array(v, float) for k, v in model.scaler.items()}
    named |= {f"c/{k}": np.array(float(v)) for k, v in model.config.items()}
    np.savez(out, features=np.array(model.features), **named)
    return out.getvalue()


def load(spark: SparkSession, path: str) -> Checkpoint:
    """From any store that Spark reads."""
    content = spark.read.format("binaryFile").load(path).select("content").first()
    if content is None:
        raise FileNotFoundError(path)
    with np.load(io.BytesIO(content[0]), allow_pickle=False) as z:
        part = lambda p: {k[2:]: z[k] for k in z.files if k.startswith(p)}
        config = {k: float(v) for k, v in part("c/").items()}
        return Checkpoint(part("w/"), [str(f) for f in z["features"]], config, {k: v.tolist() for k, v in part("q/").items()})
