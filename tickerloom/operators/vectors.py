"""Vectors per row: projection, similarity, fusion, and batch jobs with a pluggable model."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, PCA, HashingTF, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from tickerloom.functions.numbers import col
from tickerloom.functions.sentiment import sentiment_score
from tickerloom.functions.text import normalise_text, words_of
from tickerloom.functions.vectors import as_doubles, concat_vectors, cosine
from tickerloom.session import durable

# ---- fixed values: width of fused vectors, slope below zero, sizes of the projection ----
FUSED_WIDTH, NEGATIVE_SLOPE = 768, 0.01
PCA_SIZE = 8
# Hash of the layers' weights; a layer has fewer inputs and outputs than LAYER_CELLS.
HASH_FACTOR, HASH_PRIME, LAYER_CELLS = 48271, 2147483647, 4096
# Word lists of the built-in scorer; a trained model can be passed instead.
POSITIVE_WORDS = "gain gains growth rise rises rally strong profit beat record up good great best high positive".split()
NEGATIVE_WORDS = "loss losses fall falls drop decline weak miss fear down bad worst low negative risk crisis".split()
# Bytes of a batch of prompts, about (or one prompt).
PROMPT_BYTES = 8 << 20
# ---- end of fixed values ----


def market_vector(df: DataFrame, numbers: Sequence[str], vector: str, name: str = "market_vector") -> DataFrame:
    """Numeric columns followed by the text vector."""
    return df.withColumn(name, concat_vectors(numbers, vector))


def centre(df: DataFrame, vector: str) -> DataFrame:
    mean = df.agg(vector_to_array(Summarizer.mean(array_to_vector(as_doubles(vector))))).scalar()
    centred = F.zip_with(as_doubles(vector), F.col("_mean"), lambda x, m: x - m)
    return df.withColumn("_mean", mean).withColumn(vector, centred).drop("_mean")


def pca(df: DataFrame, vector: str, k: int = PCA_SIZE) -> DataFrame:
    """Replace a vector by its first k principal components.

    Spark projects without centring, so vectors are centred first. Each component is
    turned so that its largest loading is positive. Only the d x k loadings reach the driver.
    The centred rows are checkpointed, as fitting and projecting both read them.
    """
    ready = durable(centre(df, vector).withColumn("_v", array_to_vector(vector)))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(ready)
    loadings = model.pc.toArray()
    signs = np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(k)])
    turned = F.zip_with(vector_to_array("_p"), F.array(*[F.lit(float(s)) for s in signs]), lambda x, s: x * s)
    return model.transform(ready).withColumn(vector, turned).drop("_v", "_p")


def modal_similarity(df: DataFrame, numbers: Sequence[str], vector: str) -> DataFrame:
    """Cosine of scaled numbers and the text vector reduced to the same length."""
    reduced = pca(df, vector, len(numbers))
    return reduced.withColumn("similarity", cosine(F.array(*[col(c).cast("double") for c in numbers]), vector))


def hashed_layer(layer: int, inputs: int, outputs: int, seed: int = 0) -> np.ndarray:
    """Weights of a linear layer, biases in the last row: evenly spread numbers within 1 / sqrt(inputs).

    They come from integer arithmetic on (layer, input, output, seed), so that any engine can repeat them.
    """
    if max(inputs, outputs) >= LAYER_CELLS:
        raise ValueError(f"a layer has fewer than {LAYER_CELLS} inputs and outputs")
    cell = (layer * LAYER_CELLS + np.arange(inputs + 1)[:, None]) * LAYER_CELLS + np.arange(outputs) + seed + 1
    first = cell * HASH_FACTOR % HASH_PRIME
    return (2.0 * ((first * first + cell) % HASH_PRIME) / HASH_PRIME - 1) / np.sqrt(inputs)


def fusion_layers(numbers: int, texts: int, width: int, seed: int) -> list[np.ndarray]:
    """Layers of the fusion: lift of either side, (value, output) of the attention to either side, and the last layer."""
    sizes = [(numbers, width), (texts, width), *[(width, width)] * 4, (2 * width, width)]
    return [hashed_layer(k, a, b, seed) for k, (a, b) in enumerate(sizes)]


def fuse_vectors(df: DataFrame, numbers: str, texts: str, number_size: int, text_size: int,
                 width: int = FUSED_WIDTH, seed: int = 42, name: str = "market_vector") -> DataFrame:
    """Two-way fusion of a number array and a text array through fixed linear layers with biases.

    Both sides are lifted to the common width, attend to each other, and the two results side by
    side pass a last layer. With one item per sequence every attention weight is 1, so attention
    is the value layer and the output layer of the other side. The layers come from the seed inside
    the task, which costs less than sending them. Rows with a NULL array have a NULL vector.
    """
    @F.pandas_udf("array<double>")
    def fuse(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        from_numbers, from_texts, value_texts, out_texts, value_numbers, out_numbers, last = fusion_layers(number_size, text_size, width, seed)

        def through(x: np.ndarray, m: np.ndarray) -> np.ndarray:
            return x @ m[:-1] + m[-1]

        def lift(rows: pd.Series, m: np.ndarray) -> np.ndarray:
            x = through(np.stack([np.asarray(v, dtype=float) for v in rows]), m)
            return np.where(x < 0, NEGATIVE_SLOPE * x, x)
        for a, b in batches:
            out = pd.Series([None] * len(a), dtype=object)
            there = np.flatnonzero(a.notna().to_numpy() & b.notna().to_numpy())
            if len(there):
                to_texts = through(through(lift(b.iloc[there], from_texts), value_texts), out_texts)
                to_numbers = through(through(lift(a.iloc[there], from_numbers), value_numbers), out_numbers)
                for at, row in zip(there, through(np.hstack([to_texts, to_numbers]), last), strict=True):
                    out.iloc[at] = row
            yield out
    return df.withColumn(name, fuse(as_doubles(numbers), as_doubles(texts)))


def embed_texts(df: DataFrame, text: str, encoder: Callable[[], Callable[[list[str]], np.ndarray]],
                name: str = "emb") -> DataFrame:
    """Vectors from a model. `encoder()` loads it once per task and returns texts -> matrix."""
    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = encoder()
        for texts in batches:
            yield pd.Series(list(np.asarray(model(texts.fillna("").tolist()), dtype=np.float32)), dtype=object)
    return df.withColumn(name, encode(col(text)))


def hashed_vectors(df: DataFrame, text: str, size: int = 64, name: str = "emb") -> DataFrame:
    """Built-in encoder: hashed word counts, weighted by rarity, scaled to length one."""
    steps = Pipeline(stages=[HashingTF(numFeatures=size, inputCol="_words", outputCol="_tf"),
                             IDF(inputCol="_tf", outputCol="_idf"), Normalizer(inputCol="_idf", outputCol="_unit")])
    words = df.withColumn("_words", words_of(text))
    out = steps.fit(words).transform(words)
    return out.withColumn(name, vector_to_array("_unit", "float32")).drop("_words", "_tf", "_idf", "_unit")


def score_sentiment(df: DataFrame, text: str, scorer: Callable[[], Callable[[list[str]], np.ndarray]]) -> DataFrame:
    """Scores from a model. `scorer()` returns texts -> rows of (neg, neu, pos)."""
    @F.pandas_udf("neg double, neu double, pos double")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = scorer()
        for texts in batches:
            yield pd.DataFrame(np.asarray(model(texts.tolist()), dtype=float), columns=["neg", "neu", "pos"])
    scored = df.withColumn("_s", label(normalise_text(text)))
    return scored.withColumn("sentiment_score", sentiment_score("_s.neg", "_s.neu", "_s.pos")).drop("_s")


def word_list_scores(df: DataFrame, text: str) -> DataFrame:
    """Built-in scorer: add-one shares of positive, negative and other words."""
    words = words_of(text)
    counted = df.withColumns({
        "_p": F.size(F.filter(words, lambda w: w.isin(POSITIVE_WORDS))),
        "_n": F.size(F.filter(words, lambda w: w.isin(NEGATIVE_WORDS)))})
    total = F.col("_p") + F.col("_n") + 1
    return counted.withColumn("sentiment_score", sentiment_score(
        F.col("_n") / total, 1 / total, F.col("_p") / total)).drop("_p", "_n")


def score_prompts(df: DataFrame, prompt: str, client: Callable[[], Callable[[list[str]], list[str]]],
                  name: str = "output") -> DataFrame:
    """Model output per prompt. `client()` returns prompts -> outputs, once per task.

    Batches are bounded by bytes, since a prompt may hold all news of a date. A prompt is dropped before the next batch comes.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(PROMPT_BYTES))

    @F.pandas_udf("string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = client()
        for prompts in batches:
            found = pd.Series(model(prompts.tolist()), dtype=object)
            del prompts
            yield found
            del found
    return df.withColumn(name, ask(col(prompt)))
