"""Whether an index and an embedding model belong together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import ConfigurationError, storable_identity


def identity_counts(chunks: DataFrame) -> DataFrame:
    """model_identity (empty: unstamped), n. A table from before the column is all unstamped."""
    identity = F.coalesce("model_identity", F.lit("")) if "model_identity" in chunks.columns else F.lit("")
    return chunks.select(identity.alias("model_identity")).groupBy("model_identity").agg(F.count("*").alias("n"))


def verify(chunks: DataFrame, identity: str | None) -> None:
    """Refuses to mix vectors of different or unknown models; an empty index takes any stamped model."""
    found = {r[0]: r[1] for r in identity_counts(chunks).limit(100).collect()}
    stamped = sorted(k for k in found if k)
    there = ", ".join(f"{found[k]} of {k or 'no model'}" for k in sorted(found)) or "none"
    if identity is not None:
        storable_identity(identity)
    if not found:
        if identity == "":
            raise ConfigurationError("the model has no identity to stamp a new index with")
        return
    if len(stamped) > 1:
        raise ConfigurationError(f"the index mixes models ({there}): rebuild it")
    if "" in found:
        raise ConfigurationError(f"the index holds chunks of an unknown model ({there}): rebuild it")
    if not identity:
        raise ConfigurationError(f"the index holds chunks of {stamped[0]}, but no model identity was given")
    if identity != stamped[0]:
        raise ConfigurationError(f"the index holds chunks of {stamped[0]}, not of {identity}: rebuild it or use that model")
