"""Text to unit vectors: a native hashed tf-idf model, or any user function."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import IDF, ElementwiseProduct, HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions import vectors as V

Embedder = Callable[[list[str]], list]


@dataclass(frozen=True)
class TextModel:
    """A fitted hashed tf-idf model: one weight per hash dimension. Texts embedded with one model are comparable."""

    weights: tuple[float, ...]


def fit_embedder(corpus: DataFrame, text: str = "text", dim: int = 256) -> TextModel:
    """Smoothed inverse document frequencies, ``ln((n + 1) / (df + 1)) + 1``, of ``dim`` hash dimensions.

    One aggregation over the corpus; ``dim`` numbers reach the driver. Terms share dimensions, more of them the larger
    the vocabulary: 256 suits some ten thousand terms, a larger corpus wants a larger ``dim``.
    """
    words = corpus.select(X.words_of(F.col(text)).alias("_words"))
    tf = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dim).transform(words.filter("_words IS NOT NULL"))
    if tf.isEmpty():
        return TextModel((1.0,) * dim)
    idf = IDF(inputCol="_tf").fit(tf)
    return TextModel(tuple(float(math.log((idf.numDocs + 1) / (df + 1)) + 1) for df in idf.docFreq))


def embed(df: DataFrame, text: str = "text", embedder: Embedder | None = None, dim: int = 256,
          out: str = "vec", model: TextModel | None = None) -> DataFrame:
    """Add a unit vector per row.

    By default with ``model``, or one fitted on ``df`` itself when none is given: give the same model for everything
    that is to be compared. ``embedder`` gets a list of texts per Arrow batch instead. Null texts have the zero vector.
    """
    if embedder is None:
        model = model or fit_embedder(df, text, dim)
        words = df.withColumn("_words", F.coalesce(X.words_of(F.col(text)), F.array().cast("array<string>")))
        tf = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=len(model.weights)).transform(words)
        scaled = ElementwiseProduct(scalingVec=Vectors.dense(model.weights), inputCol="_tf", outputCol="_scaled").transform(tf)
        return scaled.withColumn(out, V.l2_normalize(vector_to_array("_scaled"))).drop("_words", "_tf", "_scaled")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            m = np.asarray(list(embedder(pdf[text].tolist())), dtype=np.float64).reshape(len(pdf), -1)
            length = np.linalg.norm(m, axis=1, keepdims=True)
            yield pdf.assign(**{out: list(np.divide(m, length, out=m.copy(), where=length > 0))})

    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])
    return df.mapInPandas(run, schema)


def embed_missing(docs: DataFrame, text: str = "summary", vec: str = "summary_vec",
                  embedder: Embedder | None = None, model: TextModel | None = None) -> DataFrame:
    """Fill in vectors only for rows that have a current summary and no vector yet; the rest passes unchanged.

    ``model`` is the one that the vectors there were made with; without it, one is fitted on all the texts of ``docs``.
    """
    if embedder is None and model is None:
        model = fit_embedder(docs, text)
    due = (F.col("enrich_status").eqNullSafe("ok") & F.col("enriched_sha").eqNullSafe(F.col("sha256"))
           & F.col(text).isNotNull() & F.col(vec).isNull())
    todo = embed(docs.filter(due).drop(vec), text, embedder, out=vec, model=model).select(*docs.columns)
    kind = docs.schema[vec].dataType.elementType
    return docs.filter(~due).unionByName(todo.withColumn(vec, F.transform(vec, lambda x: x.cast(kind))))
