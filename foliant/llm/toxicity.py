"""Toxicity by a classifier chain of linear models.

Categories are predicted one after the other; each logistic model sees the text's features and the probabilities that the models
before it gave. For training those probabilities are out-of-fold: a model fitted on the other FOLDS - 1 folds (by crc32 of the
text) predicts each fold, so later models learn from what earlier ones say about unseen texts. The fits of a category, one for
each fold and one for all, are tasks; each gets the sample's features, at most SAMPLE * TERMS term numbers, by broadcast.

Features: lower-cased words and their prefixes of 4 to 6 letters, those TERMS whose shares differ most by category (by at least SURE standard errors), present or not, and
six measures of form. Vocabulary and weights are fitted on about SAMPLE labelled documents at most (by hash of doc_id).

Defined results: a null text is empty; unlabelled, contradictory (several labels for one doc_id: the largest counts) and
missing labels do not stop a fit; with no positive or no negative example of a category its probability is the share of positives
(0 if there are no labels). An empty table gives an empty result. Only doc_id, text and the label columns are read.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_sample, materialize, portions

SAMPLE, TERMS, FOLDS, STEPS, DECAY, LEAST, SURE, PREFIXES, MEMORY = 10000, 1500, 5, 300, 1e-4, 4, 6.0, (4, 5, 6), 1 << 18
_words = re.compile(r"[^\W\d_]+").findall


def terms_of(word: str) -> list[str]:
    return [word, *(word[:k] + "-" for k in PREFIXES if len(word) > k)]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def form(text: str, words: list[str]) -> list[float]:
    """Measures between 0 and 1 of a text's form."""
    n = max(1, len(text))
    letters = sum(map(len, words))
    lines = text.split("\n")
    capitals = sum(map(str.isupper, words)) / max(1, len(words))
    return [letters / n, text.count(" ") / n, capitals, len(set(words)) / max(1, len(words)), len(set(lines)) / len(lines), min(1.0, np.log1p(n) / 12)]


class Linear:
    """Logistic model over sparse 0/1 terms and dense columns."""

    def __init__(self, terms: int, dense: int):
        self.w, self.d, self.b = np.zeros(terms), np.zeros(dense), 0.0

    def logit(self, owner: np.ndarray, term: np.ndarray, dense: np.ndarray) -> np.ndarray:
        return np.clip(np.bincount(owner, self.w[term], len(dense)) + dense @ self.d + self.b, -30, 30)

    def fit(self, owner: np.ndarray, term: np.ndarray, dense: np.ndarray, y: np.ndarray) -> Linear:
        """Adam on the full batch; classes are weighed alike, then the bias goes halfway back to their shares."""
        n, p = len(y), y.mean() if len(y) else 0.0
        if p in (0.0, 1.0):
            self.b = float(np.clip(np.log(max(p, 1e-12) / max(1 - p, 1e-12)), -30, 30))
            return self
        weight = np.where(y > 0, 0.5 / p, 0.5 / (1 - p)) / n
        size = len(self.w) + len(self.d) + 1
        m, v, x = np.zeros(size), np.zeros(size), np.zeros(size)
        for t in range(1, STEPS + 1):
            r = (sigmoid(self.logit(owner, term, dense)) - y) * weight
            g = np.concatenate([np.bincount(term, r[owner], len(self.w)), dense.T @ r, [r.sum()]]) + DECAY * x
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            x -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
            self.w, self.d, self.b = x[: len(self.w)], x[len(self.w) : -1], float(x[-1])
        self.b += 0.5 * float(np.log(p / (1 - p)))
        return self


class Chain:
    def __init__(self, categories: list[str], vocabulary: list[str], models: list[Linear]):
        self.categories, self.models = categories, models
        self.place = {t: i for i, t in enumerate(vocabulary)}
        self.memory: dict[str, tuple[int, ...]] = {}

    def features(self, text: str) -> tuple[list[int], list[float]]:
        words = _words(text)
        found: set[int] = set()
        for w in set(map(str.lower, words)):
            own = self.memory.get(w)
            if own is None:
                own = tuple(self.place[t] for t in terms_of(w) if t in self.place)
                if len(self.memory) < MEMORY:
                    self.memory[w] = own
            if own:
                found.update(own)
        return sorted(found), form(text, words)

    def probabilities(self, texts: list[str]) -> np.ndarray:
        """[texts, categories]; each model sees the probabilities of those before it."""
        rows = [self.features(t) for t in texts]
        owner = np.repeat(np.arange(len(rows)), [len(t) for t, _ in rows])
        term = np.array([i for t, _ in rows for i in t], np.int64)
        dense = np.array([d for _, d in rows]).reshape(len(rows), 6)
        out = np.zeros((len(rows), 0))
        for model in self.models:
            out = np.column_stack([out, sigmoid(model.logit(owner, term, np.column_stack([dense, out])))])
        return out


def _labelled(docs: DataFrame, labels: DataFrame, categories: list[str], sample: int) -> DataFrame:
    """doc_id, text, y (array of 0/1 by category) of at most about `sample` labelled documents."""
    one = labels.select(F.col("doc_id").cast("long").alias("label_id"), *(F.col(c).cast("int").alias(c) for c in categories)).dropna()
    one = one.groupBy("label_id").agg(*(F.max(c).alias(c) for c in categories))
    one = materialize(one.select("label_id", F.array(*categories).alias("y")), "toxic-labels")
    one = hash_sample(one, sample, one.count(), "label_id")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return materialize(rows.join(one, F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "y"), "toxic-sample")


def fit(docs: DataFrame, labels: DataFrame, categories: list[str], sample: int = SAMPLE) -> Chain:
    """The chain for the 0/1 label columns `categories`, in this order."""
    rows, c = _labelled(docs, labels, categories, sample), len(categories)

    def count(batches):
        found: dict[str, np.ndarray] = {}
        total = np.zeros(c + 1, np.int64)
        for b in portions(batches):
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                one = np.array([1, *y], np.int64)
                total += one
                for t in {t for w in set(_words(text.lower())) for t in terms_of(w)}:
                    if t in found:
                        found[t] += one
                    else:
                        found[t] = one.copy()
        kept = list(found.items())
        n = np.array([n for _, n in kept] + [total]).reshape(-1, c + 1)
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in kept] + [""]), *(pa.array(n[:, k]) for k in range(c + 1))], names=["term", *(f"n{k}" for k in range(c + 1))])

    columns = [f"n{k}" for k in range(c + 1)]
    counts = rows.select("text", "y").repartition(rows.sparkSession.sparkContext.defaultParallelism).mapInArrow(count, "term string, " + ", ".join(f"{n} long" for n in columns))
    counts = materialize(counts.groupBy("term").agg(*(F.sum(n).alias(n) for n in columns)), "toxic-terms")
    total = counts.where("term = ''").first()
    vocabulary: set[str] = set()
    for k in range(1, c + 1):
        yes, no = max(1, total[columns[k]] if total else 1), max(1, total["n0"] - total[columns[k]] if total else 1)
        share, other = F.col(columns[k]) / yes, (F.col("n0") - F.col(columns[k])) / no
        pooled = F.col("n0") / (yes + no)
        z = F.abs(share - other) / F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(1e-12)) * (1 / yes + 1 / no))
        best = counts.where((F.col("term") != "") & (F.col("n0") >= LEAST)).select("term", z.alias("z")).where(F.col("z") >= SURE).orderBy(F.desc("z"), "term").limit(TERMS)
        vocabulary |= {r[0] for r in best.collect()}
    chain = Chain(categories, sorted(vocabulary), [])

    def measure(batches):
        for b in portions(batches):
            f = [chain.features(t) for t in b.column(1).to_pylist()]
            fold = [zlib.crc32(t.encode("utf-8", "replace")) % FOLDS for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([t for t, _ in f], pa.list_(pa.int32())), pa.array([d for _, d in f], pa.list_(pa.float64())), pa.array(fold, pa.int32())], names=["doc_id", "y", "t", "d", "fold"])

    data = rows.mapInArrow(measure, "doc_id long, y array<int>, t array<int>, d array<double>, fold int").toPandas()
    data = data.sort_values("doc_id", kind="stable")
    n = len(data)
    y = np.stack(data.y.to_numpy()).astype(float) if n else np.zeros((0, c))
    dense = np.stack(data.d.to_numpy()) if n else np.zeros((0, 6))
    owner = np.repeat(np.arange(n, dtype=np.int32), data.t.map(len).to_numpy(int)) if n else np.zeros(0, np.int32)
    term = np.concatenate(data.t.to_numpy()).astype(np.int32) if n else np.zeros(0, np.int32)
    for k in range(c):
        last = k + 1 == c
        model, unseen = fitted(docs.sparkSession, owner, term, dense, y[:, k], data.fold.to_numpy(), len(chain.place), 0 if last else FOLDS)
        chain.models.append(model)
        dense = np.column_stack([dense, unseen])
    return chain


def fitted(spark: SparkSession, owner: np.ndarray, term: np.ndarray, dense: np.ndarray, y: np.ndarray, fold: np.ndarray, terms: int, folds: int) -> tuple[Linear, np.ndarray]:
    """The model of a category and each row's probability by the model of the other folds; every fit is a task of its own."""
    sent = spark.sparkContext.broadcast((owner, term, dense, y, fold))

    def run(batches):
        owner, term, dense, y, fold = sent.value
        for b in batches:
            for f in b.column(0).to_pylist():
                rest = fold != f  # fold -1, of no row, is the fit on all of them
                new, inside = np.cumsum(rest) - 1, rest[owner]
                model = Linear(terms, dense.shape[1]).fit(new[owner[inside]], term[inside], dense[rest], y[rest])
                unseen = sigmoid(model.logit(owner, term, dense))[~rest]
                lists = [pa.array([np.asarray(x, float).tolist()], pa.list_(pa.float64())) for x in (model.w, model.d, [model.b], unseen)]
                yield pa.RecordBatch.from_arrays([pa.array([f]), *lists], names=["fold", "w", "d", "b", "unseen"])

    schema = "fold long, w array<double>, d array<double>, b array<double>, unseen array<double>"
    found = {r.fold: r for r in spark.range(-1, folds, 1, folds + 1).mapInArrow(run, schema).collect()}
    model, unseen = Linear(terms, dense.shape[1]), np.zeros(len(y))
    model.w, model.d, model.b = np.array(found[-1].w), np.array(found[-1].d), found[-1].b[0]
    for f in range(folds):
        unseen[fold == f] = found[f].unseen
    sent.destroy()
    return model, unseen


def predict(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id and p_<category> of every row."""
    names = [f"p_{c}" for c in chain.categories]

    def run(batches):
        for b in portions(batches):
            p = chain.probabilities([t or "" for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(p[:, k]) for k in range(p.shape[1]))], names=["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, " + ", ".join(f"{n} double" for n in names))


def keep(docs: DataFrame, chain: Chain, category: str, most: float = 0.5) -> DataFrame:
    """The documents whose probability of the category is below `most`, all columns kept."""
    k = chain.categories.index(category)

    def run(batches):
        for b in portions(batches):
            texts = [t or "" for t in b.column("text").cast(pa.string()).to_pylist()]
            if texts:
                yield b.filter(pa.array(chain.probabilities(texts)[:, k] < most))

    return docs.mapInArrow(run, docs.schema)


def with_low_quality(labels: DataFrame) -> DataFrame:
    """labels with low_quality, 1 where quality is 0."""
    return labels.select("doc_id", (F.col("quality") == 0).cast("int").alias("low_quality"), F.col("toxic").cast("int").alias("toxic"))
