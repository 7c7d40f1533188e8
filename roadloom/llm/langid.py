"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Fitting, on a sample of at most PER_LANG labelled rows of each language (the
smallest by hash of id, language and text; the bound is what the driver ever holds): executors
turn whole texts into hashed n-gram counts; the driver takes IDF from document
frequencies over all labelled rows, trains by follow-the-regularised-leader (per-coordinate, elastic net),
and fits one softmax temperature on a fifth of the sample kept out of training.
Prediction runs in Arrow batches on whole texts with a weight table of fixed size.

Edge cases: null text, or a text without a letter, is und with score 0.0.
Without any labelled row everything is und. Rows are labelled by lang only in
fitting; lang, source and ids are never inputs of a prediction. Repeated rows each
get a row. An empty table gives an empty result. Extra columns pass through
predict() unless named like a result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadloom.llm.shared import discard, give_back, stash

BINS = 1 << 14
GRAMS = (1, 2, 3)
PER_LANG = 600
#: Of all languages together, the first rows of each before the second of any.
MAX_ROWS = 12_000
UNKNOWN = "und"
#: N-grams are hashed in runs of so many at a time, so that memory stays near the text's size.
RUN = 200_000

_OTHER = re.compile(r"[\W\d_]+")


def bin_counts(text: str) -> np.ndarray:
    """Counts of the text's hashed n-grams of lower-cased letters, words apart; length BINS."""
    total = np.zeros(BINS, np.int64)
    whole = np.frombuffer((" " + _OTHER.sub(" ", text.lower()).strip() + " ").encode("utf-32-le"), np.uint32)
    for at in range(0, len(whole), RUN):
        # the n-grams that start in this run; the last ones reach into the next
        c = whole[at : at + RUN + max(GRAMS) - 1]
        h = np.zeros(len(c), np.uint32)
        for n in GRAMS:
            if len(c) < n:
                break
            h = (h[: len(c) - n + 1] * np.uint32(0x01000193)) ^ c[n - 1 :]
            mixed = (h[:RUN] ^ np.uint32((n * 0x9E3779B1) & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            total += np.bincount(mixed >> np.uint32(18), minlength=BINS)
    return total


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray  # BINS
    weights: np.ndarray  # BINS x langs
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = _tfidf(counts, self.idf[at])
        return x @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        counts = bin_counts(text)
        at = np.nonzero(counts)[0]
        z = self.logits(at, counts[at]) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def _tfidf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    norm = np.sqrt((x * x).sum())
    return x / norm if norm else x


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, *, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, epochs: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial FTRL-proximal; rows: (bins, values, class). Returns weights (bins + 1 x classes) as (weights, bias)."""
    z, n = np.zeros((BINS + 1, classes)), np.zeros((BINS + 1, classes))

    def solve(at: np.ndarray) -> np.ndarray:
        w = -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(z[at]) <= l1, 0.0, w)

    rng = np.random.default_rng(0)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x, y = rows[i]
            at, x = np.append(at, BINS), np.append(x, 1.0)
            w = solve(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = solve(np.arange(BINS + 1))
    return w[:BINS], w[BINS]


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """(rows, in how many of them each bin occurs) of texts (text); a vector of BINS entries a task is summed in Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(BINS + 1, np.int64)
        for b in batches:
            df[BINS] += b.num_rows
            for t in b.column("text"):
                df[:BINS] += bin_counts(t.as_py()) > 0
        give_back()
        at = np.nonzero(df)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at], pa.int64())], names=["bin", "n"])

    total = np.zeros(BINS + 1, np.int64)
    for r in texts.select("text").mapInArrow(count, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        total[r["bin"]] = r["n"]
    return int(total[BINS]), total[:BINS]


def smallest(rows: DataFrame, per_lang: int) -> DataFrame:
    """key, lang, k: the per_lang smallest keys of each language in rows (key: a hash, lang), repeated ones each, numbered by k.

    A threshold on the key, from each language's number of rows, lets about four times
    per_lang through to the window; where repeated keys make that too few, the threshold grows.
    """
    spark = rows.sparkSession
    # a row for each language; of more than MAX_ROWS languages the first MAX_ROWS by name
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy("lang").limit(MAX_ROWS).collect()}
    factor = 4
    while True:
        bound = [(lang, int(min(2**64 * factor * per_lang // n, 2**64 - 1)) - 2**63) for lang, n in sizes.items()]
        bounds = F.broadcast(spark.createDataFrame(bound, "lang string, bound long"))
        order = Window.partitionBy("lang").orderBy("key")
        found = rows.join(bounds, "lang").where("key <= bound").select("key", "lang").withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_lang)
        if all(n <= factor * per_lang for n in sizes.values()):
            return found
        got = {r["lang"]: r["count"] for r in found.groupBy("lang").count().collect()}
        if all(got.get(lang, 0) >= min(n, per_lang) for lang, n in sizes.items()):
            return found
        factor *= 64


def fit(labelled: DataFrame, *, per_lang: int = PER_LANG) -> Model:
    """labelled: (doc_id, text, lang). Rows without text or lang teach nothing, nor do languages beyond the first MAX_ROWS by name."""
    known = labelled.where("lang IS NOT NULL AND text IS NOT NULL")
    known = known.select("lang", "text", F.xxhash64(F.col("doc_id").cast("long"), "lang", "text").alias("key"))
    keys = stash(smallest(known.select("key", "lang"), per_lang), "language-sample")
    times = Counter(r["key"] for r in keys.orderBy("k", "lang").limit(MAX_ROWS).collect())
    discard(keys)
    if not times:
        return Model([], np.zeros(BINS), np.zeros((BINS, 0)), np.zeros(0))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            new = [k not in seen and not seen.add(k) for k in b.column("key").to_pylist()]
            b = b.filter(pa.array(new, pa.bool_()))
            got = []
            for t in b.column("text"):
                c = bin_counts(t.as_py())
                at = np.nonzero(c)[0]
                got.append(at.astype("<u4").tobytes() + c[at].astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("lang"), pa.array(got, pa.binary())], names=["key", "lang", "counts"])
        give_back()

    chosen = known.where(F.col("key").isin(list(times))).select("key", "lang", "text")
    # copies of a row may lie in several tasks: one comes to the driver
    sample = chosen.mapInArrow(count, "key long, lang string, counts binary").dropDuplicates(["key"]).collect()
    sample.sort(key=lambda r: r["key"])
    langs = sorted({r["lang"] for r in sample})
    rows, kept_out = [], []
    for i, r in enumerate(sample):
        both = np.frombuffer(r["counts"], "<u4")
        at, c = both[: len(both) // 2].astype(np.int64), both[len(both) // 2 :].astype(np.float64)
        rows += [(at, c, langs.index(r["lang"]))] * times[r["key"]]
        kept_out += [i % 5 == 4] * times[r["key"]]
    n, df = document_frequencies(known)
    idf = np.log((1 + n) / (1 + df)) + 1
    rows = [(at, _tfidf(c, idf[at]), y) for at, c, y in rows]
    apart = [i for i, out in enumerate(kept_out) if out]
    weights, bias = ftrl([r for r, out in zip(rows, kept_out, strict=True) if not out], len(langs))
    model = Model(langs, idf, weights, bias)
    if apart:
        z = np.array([rows[i][1] @ weights[rows[i][0]] + bias for i in apart])
        y = np.array([rows[i][2] for i in apart])
        model.temperature = _temperature(z, y)
    return model


def _temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least cross-entropy, out of a grid from 0.05 to 20."""

    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]).mean())

    return min(np.geomspace(0.05, 20, 121), key=loss)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BINS x languages, a fixed size
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]

    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def say(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in it:
            got = [shared.value.predict(t) for t in texts]
            yield pd.DataFrame(got, columns=["lang_pred", "score"])
        give_back()

    return docs.select(*names, say("text").alias("_p")).select(*names, "_p.lang_pred", "_p.score")
