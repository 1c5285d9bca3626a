"""A set-wise reranker: one attention layer without positions over the features of a query's candidates, in numpy.

Features are normalised, encoded (linear, GELU, layer norm), put through one transformer encoder layer (four heads, norm
behind each part) and a linear head. A query has 25 candidates at most, so a group is small and bounded.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.operators import decide

INPUT, HIDDEN, HEADS, FEEDFORWARD, MOST = 21, 32, 4, 64, 25
#: Sets of candidates that are scored together.
SETS = 512
#: The names of the weights and their shapes (rows give outputs).
SHAPES = {
    "encoder": (HIDDEN, INPUT), "encoder_bias": (HIDDEN,), "encoder_gain": (HIDDEN,), "encoder_shift": (HIDDEN,),
    "attention": (3 * HIDDEN, HIDDEN), "attention_bias": (3 * HIDDEN,), "output": (HIDDEN, HIDDEN), "output_bias": (HIDDEN,),
    "first_gain": (HIDDEN,), "first_shift": (HIDDEN,), "wide": (FEEDFORWARD, HIDDEN), "wide_bias": (FEEDFORWARD,),
    "narrow": (HIDDEN, FEEDFORWARD), "narrow_bias": (HIDDEN,), "second_gain": (HIDDEN,), "second_shift": (HIDDEN,), "head": (1, HIDDEN), "head_bias": (1,),
}


@lru_cache(maxsize=4)
def seeded(seed: int = 17) -> dict[str, np.ndarray]:
    """Weights by a seed, for where no trained ones are given."""
    r = np.random.default_rng(seed)
    return {n: np.ones(s) if n.endswith("gain") else np.zeros(s) if n.endswith(("bias", "shift")) else r.normal(scale=1 / math.sqrt(s[-1]), size=s) for n, s in SHAPES.items()}


def checked(weights: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The weights, if all are there, of the right shapes and finite."""
    for n, s in SHAPES.items():
        if n not in weights or np.shape(weights[n]) != s or not np.isfinite(weights[n]).all():
            raise ValueError(f"weight {n} must be finite and of shape {s}")
    return weights


def _norm(x: np.ndarray, gain: np.ndarray, shift: np.ndarray) -> np.ndarray:
    return (x - x.mean(axis=-1, keepdims=True)) / np.sqrt(x.var(axis=-1, keepdims=True) + 1e-5) * gain + shift


_erf = np.vectorize(math.erf)


def forward(x: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    """The scores of one set of candidates, a row of features for each."""
    if x.ndim != 2 or x.shape[1] != INPUT or not 1 <= len(x) <= MOST:
        raise ValueError(f"between 1 and {MOST} rows of {INPUT} features are needed")
    return _forward(x[None], w)[0]


def _forward(x: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    """``forward`` of several sets of the same size: (sets, candidates, features)."""
    h = x @ w["encoder"].T + w["encoder_bias"]
    h = _norm(h * 0.5 * (1 + _erf(h / math.sqrt(2))), w["encoder_gain"], w["encoder_shift"])
    q, k, v = np.split(h @ w["attention"].T + w["attention_bias"], 3, axis=2)
    size = HIDDEN // HEADS
    parts = [a.reshape(*x.shape[:2], HEADS, size).transpose(0, 2, 1, 3) for a in (q, k, v)]
    z = parts[0] @ parts[1].transpose(0, 1, 3, 2) / math.sqrt(size)
    z = np.exp(z - z.max(axis=3, keepdims=True))
    mixed = (z / z.sum(axis=3, keepdims=True) @ parts[2]).transpose(0, 2, 1, 3).reshape(*x.shape[:2], HIDDEN)
    h = _norm(h + mixed @ w["output"].T + w["output_bias"], w["first_gain"], w["first_shift"])
    wide = np.maximum(h @ w["wide"].T + w["wide_bias"], 0.0)
    h = _norm(h + wide @ w["narrow"].T + w["narrow_bias"], w["second_gain"], w["second_shift"])
    return (h @ w["head"].T + w["head_bias"])[:, :, 0]


def with_features(candidates: DataFrame) -> DataFrame:
    """Candidates with their 21 ``features``, the heuristic score standing in for a model's logit."""
    logit = decide.heuristic_score(F.col("normalized_title"), F.col("search_text"))
    return candidates.withColumn("features", F.array(*[c.cast("double") for c in decide.feature_vector(logit).values()]))


def scored(candidates: DataFrame, order: str, weights: dict[str, np.ndarray] | None = None, mean: list[float] | None = None, scale: list[float] | None = None) -> DataFrame:
    """``score`` of each candidate (query_id, doc_id) from all of its query's ``features``, normalised by ``mean`` and ``scale``."""
    w = checked(weights or seeded())
    m, s = np.array(mean or [0.0] * INPUT), np.array(scale or [1.0] * INPUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SETS):
                batch = whole.slice(at, SETS)
                names, features = batch.column("doc_id"), batch.column("features")
                sizes = names.value_lengths().to_numpy()
                if len(sizes) and sizes.max() > MOST:
                    raise ValueError(f"between 1 and {MOST} rows of {INPUT} features are needed")
                x = (features.flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, INPUT) - m) / s
                first, score = np.cumsum(sizes) - sizes, np.empty(len(x))
                for n in np.unique(sizes):
                    each = first[sizes == n][:, None] + np.arange(n)
                    score[each] = _forward(x[each], w)
                yield pa.RecordBatch.from_arrays([batch.column("query_id").take(pa.array(np.repeat(np.arange(len(sizes)), sizes))), names.flatten(), pa.array(score)], names=["query_id", "doc_id", "score"])

    own = F.sort_array(F.collect_list(F.struct(F.col(order).cast("double").alias("at"), "doc_id", "features"))).alias("own")
    sets = candidates.groupBy("query_id").agg(own).select("query_id", F.col("own.doc_id").alias("doc_id"), F.col("own.features").alias("features"))
    return sets.mapInArrow(run, "query_id string, doc_id string, score double")
