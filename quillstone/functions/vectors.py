"""Vector arithmetic over array columns, in double precision and on the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import ConfigurationError


def doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def _fold(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(_fold(F.transform(a, lambda x: x * x)))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity; 0 if either vector is zero."""
    size = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def squared_l2(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def distance(metric: str, a: Column, b: Column) -> Column:
    """cosine: 1 - cos; dot: 1 - a.b; l2: the squared distance."""
    if metric == "cosine":
        return 1 - cosine(a, b)
    if metric == "dot":
        return 1 - dot(a, b)
    if metric == "l2":
        return squared_l2(a, b)
    raise ConfigurationError(f"unknown metric {metric!r}")


def score(metric: str, distance_: Column) -> Column:
    return 1 / (1 + distance_) if metric == "l2" else 1 - distance_


def l2_normalise(v: Column) -> Column:
    """The vector at length 1; a zero or non-finite one is refused."""
    size = norm(v)
    bad = (size == 0) | F.isnan(size) | (size == float("inf"))
    return F.when(bad, F.raise_error(F.lit("a vector of no or no finite length can't be normalised")).cast("array<double>")).otherwise(F.transform(v, lambda x: x / size))


def pool(tokens: DataFrame, key: str, how: str = "mean") -> DataFrame:
    """key, vector: the pooled token vectors of rows (key, token_pos, attended, embedding).

    mean: the mean over attended tokens; cls: the vector at the first place. A row without
    attended tokens is refused.
    """
    if how == "cls":
        return tokens.groupBy(key).agg(doubles(F.min_by("embedding", "token_pos")).alias("vector"))
    if how != "mean":
        raise ConfigurationError(f"unknown pooling {how!r}")
    places = tokens.select(key, "attended", F.posexplode(doubles("embedding")).alias("i", "x"))
    means = places.groupBy(key, "i").agg(F.avg(F.when(F.col("attended"), F.col("x"))).alias("x"))
    vector = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"])
    short = F.count("x") < F.count("*")
    return means.groupBy(key).agg(F.when(short, F.raise_error(F.lit("a row has no attended token")).cast("array<double>")).otherwise(vector).alias("vector"))


ACTIVATIONS = {"identity": lambda x: x, "linear": lambda x: x, "relu": lambda x: np.maximum(x, 0), "tanh": np.tanh}


@dataclass(frozen=True)
class DenseStage:
    weight: np.ndarray
    bias: np.ndarray | None = None
    activation: str = "identity"

    def __post_init__(self) -> None:
        if self.activation not in ACTIVATIONS:
            raise ConfigurationError(f"unknown activation {self.activation!r}")


def stages_from_arrays(arrays: dict[str, np.ndarray], order: Sequence[str], activations: dict[str, str] | None = None) -> list[DenseStage]:
    """Stages from arrays `<name>.weight` and `<name>.bias` in the given order; any other array is refused."""
    listed = {f"{n}.{part}" for n in order for part in ("weight", "bias")}
    if extra := sorted(set(arrays) - listed):
        raise ConfigurationError(f"arrays that no stage lists: {', '.join(extra)}")
    return [DenseStage(arrays[f"{n}.weight"], arrays.get(f"{n}.bias"), (activations or {}).get(n, "identity")) for n in order]


def dense(vector: Column, stages: Sequence[DenseStage]) -> Column:
    """act(x W^T + b), stage after stage, over whole Arrow batches."""

    @F.pandas_udf("array<double>")
    def run(v: pd.Series) -> pd.Series:
        if not len(v):
            return v
        x = np.stack(v.to_numpy()).astype(np.float64)
        for s in stages:
            x = ACTIVATIONS[s.activation](x @ s.weight.T + (0 if s.bias is None else s.bias))
        return pd.Series(list(x))

    return run(vector)


def finalize(tokens: DataFrame, key: str, how: str, stages: Sequence[DenseStage] = ()) -> DataFrame:
    """Pooling, then the dense stages, then length 1: the order is part of the contract."""
    pooled = pool(tokens, key, how)
    if stages:
        pooled = pooled.select(key, dense(F.col("vector"), stages).alias("vector"))
    return pooled.select(key, l2_normalise(F.col("vector")).alias("vector"))
