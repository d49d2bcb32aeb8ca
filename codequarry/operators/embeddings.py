"""Text to vectors: a user-given encoder in batches, or a hashed bag of tokens."""

from __future__ import annotations

from typing import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, FloatType

Encoder = Callable[[Sequence[str]], np.ndarray]


def _encoded(encode: Encoder, texts: list[str]) -> list:
    """A vector or None for each text: when a batch fails, its texts are tried one by one."""
    try:
        return list(np.asarray(encode(texts), dtype=np.float32))
    except Exception:
        if len(texts) == 1:
            return [None]
        return [_encoded(encode, [t])[0] for t in texts]


def embed_with(df: DataFrame, make_encoder: Callable[[], Encoder], text: str = "code"):
    """Add ``embedding`` from an encoder that each task builds once.

    A text that cannot be encoded keeps its row and gets no vector, as does a null text.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = make_encoder()
        for batch in batches:
            texts = batch.to_pylist()
            known = [i for i, t in enumerate(texts) if t is not None]
            out = [None] * len(texts)
            if known:
                for i, v in zip(known, _encoded(encode, [texts[i] for i in known])):
                    out[i] = v
            yield pa.array(out, pa.list_(pa.float32()))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    encode = F.arrow_udf(run, ArrayType(FloatType())).asNondeterministic()
    return df.withColumn("embedding", encode(text))


def embed_in_batches(
    df: DataFrame, make_encoder: Callable[[], Encoder], text: str = "code", *, batch_size: int = 256
) -> DataFrame:
    """:func:`embed_with` as batch inference, for models that are dear to load: a worker keeps the
    model from task to task, and it gets at most ``batch_size`` texts at once.

    A text that cannot be encoded, or whose vector is not finite in some place, keeps its row and
    gets no vector, as does a null text, for which the model sees an empty one.
    """

    def make_predict():
        encode = make_encoder()

        def predict(texts: np.ndarray) -> np.ndarray:
            rows = _encoded(encode, texts.tolist())
            width = max((len(r) for r in rows if r is not None), default=1)
            out = np.full((len(rows), width), np.nan, np.float32)
            for i, row in enumerate(rows):
                if row is not None:
                    out[i] = row
            return out

        return predict

    model = predict_batch_udf(make_predict, return_type=ArrayType(FloatType()), batch_size=batch_size)
    infinite = F.lit(float("inf"))
    usable = F.forall("embedding", lambda x: ~F.isnan(x) & (F.abs(x) < infinite))
    told = df.withColumn("embedding", model(F.coalesce(text, F.lit(""))))
    return told.withColumn("embedding", F.when(F.col(text).isNotNull() & usable, F.col("embedding")))


def embed_hashed(df: DataFrame, text: str = "code", dimensions: int = 256) -> DataFrame:
    """Add ``embedding``: hashed token counts of unit length, all in the JVM.
    A null text has none."""
    said, tokens, counts, unit = "__said", "__tokens", "__counts", "__unit"
    out = RegexTokenizer(
        inputCol=said, outputCol=tokens, pattern=r"\w+|[^\w\s]", gaps=False,
        toLowercase=False,
    ).transform(df.withColumn(said, F.coalesce(text, F.lit(""))))
    out = HashingTF(inputCol=tokens, outputCol=counts, numFeatures=dimensions).transform(out)
    out = Normalizer(inputCol=counts, outputCol=unit, p=2.0).transform(out)
    vector = F.when(F.col(text).isNotNull(), vector_to_array(unit, "float32"))
    return out.withColumn("embedding", vector).drop(said, tokens, counts, unit)
