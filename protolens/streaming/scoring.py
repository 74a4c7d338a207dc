"""Frozen-parameter scoring of a stream of vector rows (G1-G3, M1 on micro-batches).

The reference only scores finite files; this module applies the same batch
operators to a Structured Streaming source.  Parameters are a materialized,
measured batch table joined to the stream (stream-static join, broadcast within
the limit), so each micro-batch is stateless and its work is proportional to its
rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from protolens.functions import vec as V
from protolens.operators.params import DEFAULT_MAX_BROADCAST_BYTES, estimated_bytes, materialize, pack_params


def score_stream(stream: DataFrame, params: DataFrame, keys=("layer",), label: str = "label",
                 vec: str = "vector", max_broadcast_bytes: int = DEFAULT_MAX_BROADCAST_BYTES) -> DataFrame:
    """GDA logits, probabilities, argmax and the >0.5 decision for every streamed row."""
    keys = list(keys)
    packed = materialize(pack_params(params, keys, label, ["w", "b"], "_gda"))
    # above the limit each micro-batch meets the table through a shuffle
    j = stream.join(F.broadcast(packed) if estimated_bytes(packed) <= max_broadcast_bytes else packed, keys)
    logits = F.transform("_gda", lambda p: V.dot(vec, p["w"]) + p["b"])
    return (j.withColumn("logits", logits).drop("_gda")
            .withColumn("probs", V.softmax("logits"))
            .withColumn("pred", V.argmax("probs"))
            .withColumn("score", F.element_at("probs", 2))
            .withColumn("decision", (F.col("score") > 0.5).cast("int")))
