"""Quality by compression: texts like the good ones compress better with their dictionary.

Two zstandard dictionaries are trained on good and on bad labelled texts.  Every
text is compressed in blocks with both; the normalised difference of the
compressed sizes (over the text, and the lowest block), and the ratios that
normalise it, are calibrated by logistic regression to the chance of label 1.

Labels are learnt only from rows whose ``crc32(doc_id as text) mod 5`` is not 0,
and from at most ``PER_CLASS`` of them per label (those of lowest hash, at most
``SAMPLE_BYTES`` of text): the model is fitted on the driver within that bound,
and its 150 kB go to the tasks.  Only the text is an input of a score.

Null texts are scored as empty ones.  Without labels of both kinds every score is
0.5.  Repeated rows are scored each; conflicting labels all count.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import release, texts_of

PER_CLASS = 6_000
SAMPLE_BYTES = 64_000_000
DICTIONARY_BYTES = 65_536
BLOCK = 1024
LEVEL = 3
THRESHOLD = 0.3


@dataclass
class Model:
    good: bytes = b""
    bad: bytes = b""
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    spread: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))


def _compressor(dictionary: bytes):
    import zstandard

    d = zstandard.ZstdCompressionDict(dictionary)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False)


def _dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; of very few samples, simply their text."""
    import zstandard

    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(4096, sum(map(len, samples)) // 8)), samples).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(samples)[:DICTIONARY_BYTES] or b"\n" * 8


def features(good, bad, text: bytes) -> list[float]:
    """Size differences and ratios of one text, over all its blocks."""
    parts = [text[k : k + BLOCK] for k in range(0, max(1, len(text)), BLOCK)]
    a = np.array([len(good.compress(p)) for p in parts], float)
    b = np.array([len(bad.compress(p)) for p in parts], float)
    n = np.array([len(p) + 1 for p in parts], float)
    d = (b - a) / (a + b)
    return [(b.sum() - a.sum()) / (a.sum() + b.sum()), d.min(), np.log(a.sum() / n.sum()), np.log(b.sum() / n.sum()), np.log((a / n).min()), np.log((b / n).min()), np.log(n.sum())]


def _design(x: np.ndarray, model: Model) -> np.ndarray:
    """A constant, the standardised features and their products."""
    z = np.clip((x - model.mean) / model.spread, -6, 6)
    i, j = np.triu_indices(z.shape[1])
    return np.column_stack([np.ones(len(z)), z, z[:, i] * z[:, j]])


def scores(model: Model, x: np.ndarray) -> np.ndarray:
    if not len(model.weights):
        return np.full(len(x), 0.5)
    return 1 / (1 + np.exp(-np.clip(_design(x, model) @ model.weights, -30, 30)))


def fit(good: list[bytes], bad: list[bytes], share_good: float) -> Model:
    """Dictionaries from the first seven tenths of each class, calibration on the rest, weighted to the natural share."""
    if len(good) < 2 or len(bad) < 2:
        return Model()
    cut = [max(1, len(c) * 7 // 10) for c in (good, bad)]
    model = Model(_dictionary(good[: cut[0]]), _dictionary(bad[: cut[1]]))
    tools = _compressor(model.good), _compressor(model.bad)
    rest = good[cut[0] :] + bad[cut[1] :]
    x = np.array([features(*tools, t) for t in rest])
    y = np.array([1.0] * (len(good) - cut[0]) + [0.0] * (len(bad) - cut[1]))
    weight = np.where(y == 1, share_good / max(y.mean(), 1e-9), (1 - share_good) / max(1 - y.mean(), 1e-9))
    model.mean, model.spread = x.mean(0), x.std(0) + 1e-6
    d = _design(x, model)
    w, ridge = np.zeros(d.shape[1]), np.eye(d.shape[1])
    for _ in range(40):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        step = np.linalg.solve((d * (weight * p * (1 - p))[:, None]).T @ d + ridge, d.T @ (weight * (p - y)) + w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    model.weights = w
    return model


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit on a bounded sample of labelled rows that are not held out."""
    known = labels.select("doc_id", "quality").where(~held_out() & F.col("quality").isin(0, 1))
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    some = known.withColumn("h", F.xxhash64("doc_id"))
    parts = [some.where(F.col("quality") == q).orderBy("h", "doc_id").limit(per_class) for q in (0, 1)]
    sample = F.broadcast(parts[0].unionByName(parts[1]))  # 2 * per_class narrow rows
    texts: dict[int, list[bytes]] = {0: [], 1: []}
    size = 0
    texts_in = docs.where(~held_out()).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    joined = texts_in.join(sample, "doc_id").select("h", "doc_id", "quality", "text")
    row = None
    for row in joined.orderBy("h", "doc_id", "text").toLocalIterator():
        texts[row["quality"]].append(row["text"].encode())
        size += len(row["text"])
        if size > sample_bytes:
            break
    model = fit(texts[1], texts[0], counts.get(1, 0) / max(1, sum(counts.values())))
    del joined, texts, row
    release()  # the sample's memory, in the driver
    return model


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])


def _scorer(shared):
    def score(batches):
        model = shared.value
        tools = (_compressor(model.good), _compressor(model.bad)) if len(model.weights) else None
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = texts_of(batch.column(2))
            x = np.array([features(*tools, t) for t in texts]) if tools else np.zeros((batch.num_rows, 7))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(scores(model, x))], schema=_SCHEMA)

    return score


def classify(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1) and predicted label."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(_scorer(shared), "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier does not reject, with all their columns, in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def keep(batches):
        m = shared.value
        tools = (_compressor(m.good), _compressor(m.bad)) if len(m.weights) else None
        for batch in batches:
            if batch.num_rows and tools:
                x = np.array([features(*tools, t) for t in texts_of(batch.column(names.index("text")))])
                batch = batch.filter(pa.array(scores(m, x) >= threshold))
            yield batch

    return docs.mapInArrow(keep, docs.schema)
