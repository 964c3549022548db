"""The embedder surface: any function from texts to vectors as a column, loaded once per worker.

``embed`` takes a loader, which is called in the Python worker and returns the function that turns a list of texts
into a matrix. Workers are reused between tasks and keep what they have loaded under the loader's ``name``,
so a model is loaded once per worker process, not per batch or task. Texts travel in Arrow batches.

The vector column is what ``routing.route_questions(vector=...)``, ``vectors.knn`` and ``vectors.catalogue_topk``
take. No model ships with the engine: ``hashed_trigrams`` is a deterministic stand-in.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tremolo.functions.text import fold
from tremolo.plans.intents import catalogue_df

BATCH_TEXTS = 256
_LOADED: dict[str, Callable] = {}  # by worker process


def loaded(name: str, load: Callable[[], Callable]) -> Callable:
    """What ``load()`` returned for ``name`` in this process; loaded at the first use."""
    if name not in _LOADED:
        _LOADED[name] = load()
    return _LOADED[name]


def embed(df: DataFrame, text: str, load: Callable[[], Callable[[Sequence[str]], np.ndarray]], name: str,
          out: str = "vector", batch: int = BATCH_TEXTS) -> DataFrame:
    """``df`` with ``out``: the vector (array<double>) of the text; NULL for a NULL text.

    The loaded function gets at most ``batch`` texts at a time and returns a row per text."""
    @pandas_udf("array<double>")
    def vectors(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        # by module, so that every task of the process shares what was loaded
        from tremolo.plans import embedder
        model = embedder.loaded(name, load)
        for texts in columns:
            given = texts.notna().to_numpy()
            rows: list = [None] * len(texts)
            at = np.flatnonzero(given)
            for lo in range(0, len(at), batch):
                part = at[lo:lo + batch]
                made = np.asarray(model(texts.iloc[part].tolist()), dtype=np.float64)
                if made.ndim != 2 or len(made) != len(part):
                    raise ValueError(f"embedder {name!r} must return a row per text")
                for k, v in zip(part.tolist(), made, strict=True):
                    rows[k] = v
            yield pd.Series(rows, index=texts.index, dtype=object)

    return df.withColumn(out, vectors(F.col(text)))


def hashed_trigrams(dims: int = 256) -> Callable[[], Callable]:
    """Loader of a deterministic embedder: counts of character trigrams, hashed into ``dims`` places
    (the first six hexadecimal digits of the trigram's MD5, modulo ``dims``)."""
    def load():
        place: dict[str, int] = {}

        def of(gram: str) -> int:
            if gram not in place:
                place[gram] = int(hashlib.md5(gram.encode()).hexdigest()[:6], 16) % dims
            return place[gram]

        def vectors(texts: Sequence[str]) -> np.ndarray:
            out = np.zeros((len(texts), dims))
            for row, t in zip(out, texts, strict=True):
                for gram, n in Counter(t[i:i + 3] for i in range(len(t) - 2)).items():
                    row[of(gram)] += n
            return out
        return vectors
    return load


def embed_questions(questions: DataFrame, text: str, load: Callable, name: str,
                    out: str = "vector") -> DataFrame:
    """``questions`` with the vector of the folded text (as the trigram router folds it)."""
    return embed(questions.withColumn("_folded", fold(F.col(text))), "_folded", load, name, out).drop("_folded")


def catalogue_vectors(spark: SparkSession, load: Callable, name: str) -> DataFrame:
    """(intent_id, vector) of all entries of the catalogue."""
    return embed_questions(catalogue_df(spark), "question", load, name).select("intent_id", "vector")
