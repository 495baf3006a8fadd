"""Encode / train / predict / score with Spark ML and a pluggable encoder.

The default text encoder is stateless (hashed character n-grams), so it can
run inside any job without a fitted vocabulary; a user encoder plugs in as
a factory of a predict function (Arrow batches, one model load per worker).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StringIndexer, StringIndexerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, functions as F, types as Ty

from tessera.operators.ngrams import CharNgrams, ngram_vectors
from tessera.operators.svm import LinearSvm, train_linear_svm


# ---------------------------------------------------------------- encoders
def char_ngram_pipeline(text_col: str, out: str = "features", n: int = 3, num_features: int = 1 << 18) -> Pipeline:
    """Stateless text encoder: characters -> n-grams -> hashed counts -> L2 normalised."""
    return Pipeline(stages=[CharNgrams(inputCol=text_col, outputCol=out, n=n, numFeatures=num_features)])


ENCODERS: dict = {}


def register_encoder(name: str, make_predict_fn) -> None:
    """Make an encoder known under a name that :func:`encode_text` accepts."""
    ENCODERS[name] = make_predict_fn


def encode_text(df: DataFrame, text_col: str, out: str = "features", encoder=None, batch_size: int = 256) -> DataFrame:
    """One vector per text.

    ``encoder=None`` uses hashed character trigrams (a Spark ML vector). Otherwise ``encoder`` is a
    factory (or its registered name) that returns ``predict(texts) -> 2-d array``; it is called once
    per worker. A row that cannot be encoded gets a null vector and the error in ``<out>_error``: a
    batch that fails is tried again row by row, so the other rows of the batch keep their vectors.
    """
    if encoder is None:
        model = char_ngram_pipeline(text_col, out).fit(df.limit(0))
        keep = df.columns + [out]
        return model.transform(df).select(*keep)
    make = ENCODERS[encoder] if isinstance(encoder, str) else encoder

    def run(batches):
        import pandas as pd
        predict = make()

        def vectors(texts):
            return [None if v is None else [float(x) for x in v] for v in predict(np.array(texts, dtype=object))]

        for col in batches:
            vecs, errors = [], []
            texts = col.tolist()
            for at in range(0, len(texts), batch_size):
                part = texts[at:at + batch_size]
                try:
                    got = [(v, None) for v in vectors(part)]
                except Exception:  # the user's code: find the rows at fault
                    got = []
                    for t in part:
                        try:
                            got.append((vectors([t])[0], None))
                        except Exception as exc:
                            got.append((None, f"{type(exc).__name__}: {exc}"))
                vecs += [v for v, _ in got]
                errors += [e for _, e in got]
            yield pd.DataFrame({"vec": vecs, "error": errors})

    from collections.abc import Iterator

    import pandas as pd
    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    udf = F.pandas_udf(run, "vec array<float>, error string")
    keep = [F.col(c) for c in df.columns if c not in (out, f"{out}_error")]
    return df.withColumn("_enc", udf(F.col(text_col))).select(*keep, F.col("_enc.vec").alias(out), F.col("_enc.error").alias(f"{out}_error"))


def layer_features(df: DataFrame, key: str, text_col: str, layers=(1, 2, 3), num_features: int = 1 << 12, keep=()) -> DataFrame:
    """Long form ``(key, layer, vec)``: one feature vector per "layer" (n-gram order), from one scan.

    A text gives a row per layer with that layer's n-grams, counted together in Arrow batches.
    """
    df = df.select(key, *keep, F.col(text_col).alias("_text"))

    def run(batches):
        for batch in batches:
            for n, at, vec in ngram_vectors(batch.column("_text"), set(layers), num_features):
                rest = batch.slice(at, len(vec)).columns[:-1]
                for _ in range(list(layers).count(n)):
                    yield pa.RecordBatch.from_arrays([*rest, pa.array([n] * len(vec), pa.int32()), vec], names=names)

    schema = Ty.StructType([*df.schema.fields[:-1], Ty.StructField("layer", Ty.IntegerType()), Ty.StructField("vec", VectorUDT())])
    names = schema.names
    return df.mapInArrow(run, schema)


def predict_similarity(pairs: DataFrame, key, left: str, right: str, n: int = 3) -> DataFrame:
    """Cosine of character n-gram count vectors for each aligned text pair (null where a text has no n-gram).

    Both texts stand in one row, so they are counted there, in Arrow batches: nothing is shuffled.
    """
    from collections import Counter

    @F.pandas_udf("double")
    def cosine_of(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x, y):
            if x is None or y is None:
                return None
            cx, cy = (Counter(t[i:i + n] for i in range(len(t) - n + 1)) for t in (x, y))
            norm = np.sqrt(float(sum(v * v for v in cx.values()))) * np.sqrt(float(sum(v * v for v in cy.values())))
            return sum(v * cy[g] for g, v in cx.items()) / norm if norm else None
        return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64").astype(object).where(lambda v: v.notna(), None)

    keys = [key] if isinstance(key, str) else list(key)
    return pairs.select(*keys, cosine_of(F.col(left), F.col(right)).alias("similarity"))


# ---------------------------------------------------------------- trainers
def random_fourier(df: DataFrame, features: str, out: str, dim: int, n_components: int = 256,
                   gamma: float = 1.0, seed: int = 42) -> DataFrame:
    """RBF-kernel approximation z(x) = sqrt(2/D) cos(Wx + b), W ~ N(0, 2 gamma), seeded.

    The projection (D x dim doubles, fixed by the parameters) is applied to
    Arrow batches, one matrix product each.
    """
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, np.sqrt(2.0 * gamma), size=(n_components, dim))
    b = rng.uniform(0.0, 2 * np.pi, size=n_components)
    scale = np.sqrt(2.0 / n_components)

    @F.arrow_udf(Ty.ArrayType(Ty.DoubleType()))
    def project(col: pa.Array) -> pa.Array:
        x = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(col), dim)
        z = scale * np.cos(x @ w.T + b)
        return pa.ListArray.from_arrays(np.arange(len(col) + 1, dtype=np.int32) * n_components, z.reshape(-1))

    arr = vector_to_array(F.col(features)) if dict(df.dtypes)[features] == "vector" else F.col(features)
    return df.withColumn(out, array_to_vector(project(arr)))


def train_kernel_svm(df: DataFrame, features: str, label: str, dim: int, n_components: int = 256,
                     gamma: float = 1.0, seed: int = 42, epochs: int = 6) -> LinearSvm:
    """RBF-kernel SVM re-aimed as random Fourier features + linear SVM."""
    z = random_fourier(df, features, "_rff", dim, n_components, gamma, seed)
    return train_linear_svm(z, "_rff", label, epochs)


def train_sequence_classifier(df: DataFrame, text_col: str, label_col: str, max_iter: int = 20):
    """Text -> label: hashed char trigrams + multinomial logistic regression (one Pipeline)."""
    idx = StringIndexer(inputCol=label_col, outputCol="_label", handleInvalid="error")
    lr = LogisticRegression(featuresCol="features", labelCol="_label", family="multinomial", maxIter=max_iter)
    stages = char_ngram_pipeline(text_col, "features", num_features=1 << 16).getStages() + [idx, lr]
    return _for_scoring(Pipeline(stages=stages).fit(df))


def _for_scoring(model):
    """The fitted indexer passes labels it has not seen, so that rows of a test set are all scored; the classes stay those of the training rows."""
    for stage in model.stages:
        if isinstance(stage, StringIndexerModel):
            stage.setHandleInvalid("keep")
    return model


def labels_of(model) -> list[str]:
    """Class names of a trained model, by class index."""
    return next(list(s.labels) for s in model.stages if isinstance(s, StringIndexerModel))


def decode_prediction(model, prediction: str = "prediction") -> Column:
    """The class name of a prediction."""
    return F.element_at(F.array(*[F.lit(x) for x in labels_of(model)]), F.col(prediction).cast("int") + 1)


# ---------------------------------------------------------------- subword pieces
def _candidates(words: DataFrame, word: str, longest: int, prefix: str) -> DataFrame:
    """Every substring of up to ``longest`` characters of each word, with its start and length."""
    w = F.col(word)
    at = words.where(F.char_length(w) > 0).select("*", F.explode(F.sequence(F.lit(1), F.char_length(w))).alias("start"))
    at = at.select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.char_length(w) - F.col("start") + 1))).alias("size"))
    cut = F.substring(w, F.col("start"), F.col("size"))
    return at.withColumn("piece", F.when(F.col("start") == 1, cut).otherwise(F.concat(F.lit(prefix), cut)))


def longest_match_pieces(words: DataFrame, vocabulary: DataFrame, word: str = "word", prefix: str = "##",
                         unk: str = "[UNK]") -> DataFrame:
    """``word, pieces`` for distinct words: greedy longest match from the left against a vocabulary table.

    Candidates are as long as the longest piece of the vocabulary.

    A word's candidate pieces are joined to the vocabulary; the longest match at each start is kept, and
    the greedy path through these is walked in the row. A word with a rest that nothing matches is ``unk``.
    """
    bare = F.when(F.col("piece").startswith(prefix), F.char_length("piece") - len(prefix)).otherwise(F.char_length("piece"))
    longest = vocabulary.agg(F.coalesce(F.max(bare), F.lit(1))).first()[0]
    cand = _candidates(words.select(word).distinct(), word, max(longest, 1), prefix)
    best = cand.join(vocabulary.select("piece").distinct(), "piece").groupBy(word, "start").agg(F.max("size").alias("size"))
    sizes = best.groupBy(word).agg(F.map_from_entries(F.collect_list(F.struct("start", "size"))).alias("m"))
    zero = F.array().cast("array<string>")
    step = lambda acc, i: F.when(acc["next"] != i, acc).otherwise(F.struct(
        F.when(F.col("m")[i].isNull(), F.lit(-1)).otherwise(i + F.col("m")[i]).cast("int").alias("next"),
        F.when(F.col("m")[i].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(
            F.concat(F.when(i == 1, F.lit("")).otherwise(F.lit(prefix)), F.substring(F.col(word), i, F.col("m")[i]))))).alias("out")))
    walked = F.aggregate(F.sequence(F.lit(1), F.char_length(word)), F.struct(F.lit(1).cast("int").alias("next"), zero.alias("out")), step)
    all_ = words.select(word).distinct().join(sizes, word, "left")
    res = all_.withColumn("_w", F.when(F.col("m").isNotNull(), walked))
    return res.select(word, F.when(F.col("_w.next") == F.char_length(word) + 1, F.col("_w.out")).otherwise(F.array(F.lit(unk))).alias("pieces"))


def subword_pieces(tokens: DataFrame, pieces: DataFrame, word: str = "word", unk: str = "[UNK]") -> DataFrame:
    """Tokens with the piece array of their word, joined from a table of distinct words; a null or unlisted word is one unknown piece."""
    t = tokens.join(pieces.select(F.col(word).alias("_word"), F.col("pieces").alias("_p")), F.col(word).eqNullSafe(F.col("_word")), "left")
    return t.withColumn("_pieces", F.when(F.size("_p") > 0, F.col("_p")).otherwise(F.array(F.lit(unk)))).drop("_word", "_p")
