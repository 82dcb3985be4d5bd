"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + <w, x> + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]), linear in the features of a text.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scatterwave.llm.common import arrow_map, fresh, held_out, slices
from scatterwave.runtime import ship

WORD_SLOTS = 2**14
FACTORS = 8
#: Labelled rows that the model is fitted on, at most: those with the smallest hash of their id.
MAX_LABELLED = 8_000
THRESHOLD = 0.3
CACHE_WORDS = 300_000
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


class WordHash(dict):
    """Slot of each word seen; forgets when full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        slot = self[word] = zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % WORD_SLOTS
        return slot


def structure(text: str, words: list[str], distinct: int) -> np.ndarray:
    """Statistics of form, each scaled to about [0, 1], and the length of the text as metadata."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n, m = max(1, len(raw)), max(1, len(words))
    counts = np.bincount(raw, minlength=256)
    letters = max(1, int(counts[65:91].sum() + counts[97:123].sum() + counts[128:].sum()))
    marks = _PUNCTUATION[raw]
    doubled = int((marks[1:] & (raw[1:] == raw[:-1])).sum())
    lines = text.split("\n")
    letters_per_word = (n - int(counts[32]) - int(counts[10])) / m
    short = sum(len(line) < 40 for line in lines) / len(lines)
    repeated = sum(map(str.__eq__, words, words[1:])) / m
    values = [
        counts[65:91].sum() / letters, counts[48:58].sum() / n * 4, marks.sum() / n * 3, doubled / n * 6, counts[33] / n * 12, counts[124] / n * 12,
        (counts[35] + counts[36] + counts[37] + counts[38] + counts[42]) / n * 6, (counts[46] + counts[44]) / m * 3, counts[32] / n * 4, counts[128:].sum() / n * 3,
        min(letters_per_word / 12, 2.0), distinct / m, len(set(lines)) / len(lines), short, min(len(lines) / m * 10, 2.0),
        min(np.log1p(len(text)) / 12, 1.5), min(np.log1p(m) / 10, 1.5), float(m < 30), float(not words), repeated,
    ]
    return np.array(values, np.float32)


N_STRUCTURE = 20
#: Structure values in ranges as indicator features besides the values themselves, so that pairs of ranges can interact.
STEPS = 8
DIMENSION = WORD_SLOTS + N_STRUCTURE + N_STRUCTURE * STEPS


def features(text: str | None, slots: WordHash) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values of a whole text; null counts as empty."""
    text = text or ""
    words = text.split()
    counts = Counter(words)
    n = len(counts)
    stats = structure(text, words, n)
    at = np.fromiter(map(slots.__getitem__, counts), np.int32, n)
    tf = np.log1p(np.fromiter(counts.values(), np.float32, n))
    norm = float(np.sqrt(np.dot(tf, tf))) or 1.0
    step = np.minimum((stats * STEPS).astype(np.int32), STEPS - 1)
    return (
        np.concatenate([at, WORD_SLOTS + np.arange(N_STRUCTURE, dtype=np.int32), WORD_SLOTS + N_STRUCTURE + np.arange(N_STRUCTURE, dtype=np.int32) * STEPS + step]),
        np.concatenate([tf / norm, stats, np.full(N_STRUCTURE, 0.5, np.float32)]).astype(np.float32),
    )


@dataclass(frozen=True)
class Model:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not rows:
            return np.zeros(0)
        at, value = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
        start = np.cumsum([0, *[len(r[0]) for r in rows[:-1]]])
        v = self.factors[at] * value[:, None]
        total, square = np.add.reduceat(v, start), np.add.reduceat(v * v, start)
        z = self.bias + np.add.reduceat(self.weights[at] * value, start) + 0.5 * (total**2 - square).sum(axis=1)
        return 1.0 / (1.0 + np.exp(-np.clip(z.astype(float), -40, 40)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.02, decay: float = 2e-4, seed: int = 0) -> Model:
    """Adam on the logistic loss; words are held back harder than structure, as they are many and rare.

    No rows give a model that scores 0.5.
    """
    rng = np.random.default_rng(seed)
    w, v = np.zeros(DIMENSION, np.float32), rng.normal(0, 0.02, (DIMENSION, FACTORS)).astype(np.float32)
    if not len(rows):
        return Model(0.0, w, np.zeros_like(v))
    p = float(np.clip(labels.mean(), 0.02, 0.98))
    bias = float(np.log(p / (1 - p)))
    pull = np.full(DIMENSION, decay, np.float32)
    pull[:WORD_SLOTS] *= 10
    mw, sw, mv, sv, t = np.zeros_like(w), np.zeros_like(w), np.zeros_like(v), np.zeros_like(v), 0
    for epoch in range(epochs):
        order, step = rng.permutation(len(rows)), rate * (1 - epoch / epochs)
        for i in range(0, len(order), batch):
            own = order[i : i + batch]
            at, x = np.concatenate([rows[j][0] for j in own]), np.concatenate([rows[j][1] for j in own])
            sizes = [len(rows[j][0]) for j in own]
            start = np.cumsum([0, *sizes[:-1]])
            vx = v[at] * x[:, None]
            total = np.add.reduceat(vx, start)
            z = bias + np.add.reduceat(w[at] * x, start) + 0.5 * (total**2 - np.add.reduceat(vx * vx, start)).sum(axis=1)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[own]).astype(np.float32) / len(own)
            gr = np.repeat(g, sizes) * x
            gw = np.bincount(at, weights=gr, minlength=DIMENSION).astype(np.float32) + pull * w
            each = gr[:, None] * (np.repeat(total, sizes, axis=0) - vx)
            gv = np.stack([np.bincount(at, weights=each[:, f], minlength=DIMENSION) for f in range(FACTORS)], axis=1).astype(np.float32) + pull[:, None] * v
            t += 1
            fix1, fix2 = 1 - 0.9**t, 1 - 0.999**t
            for theta, grad, m, s in ((w, gw, mw, sw), (v, gv, mv, sv)):
                m *= 0.9
                m += 0.1 * grad
                s *= 0.999
                s += 0.001 * grad * grad
                theta -= step * (m / fix1) / (np.sqrt(s / fix2) + 1e-8)
            bias -= step * float(g.sum())
    return Model(bias, w, v)


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", max_labelled: int = MAX_LABELLED) -> Model:
    """Fit on up to ``max_labelled`` labelled rows outside the held-out fold. Null labels and ids teach nothing."""
    spark = docs.sparkSession
    ship(spark)
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(label).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    joined = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")  # max_labelled rows at most
    joined = joined.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("y").alias("y"))  # one row an id, however often it stands there

    def run(batch):
        slots = WordHash()
        pairs = [features(t, slots) for t in batch["text"]]
        return {"doc_id": batch["doc_id"], "y": np.array(batch["y"], np.float32), "at": [p[0].tobytes() for p in pairs], "value": [p[1].tobytes() for p in pairs]}

    got = arrow_map(joined.select(F.col("doc_id").cast("long"), F.col("y").cast("int"), "text"), run, "doc_id long, y float, at binary, value binary")  # packed, as the driver holds them all
    pdf = got.toArrow().to_pandas().sort_values("doc_id", kind="stable")
    rows = [(np.frombuffer(a, np.int32), np.frombuffer(v, np.float32)) for a, v in zip(pdf["at"], pdf["value"])]
    return fit(rows, pdf["y"].to_numpy(np.float32))


def score(docs: DataFrame, model: Model, carry: list[str], name: str = "score") -> DataFrame:
    """``carry`` columns and the score, called ``name``, for every row; null and empty texts have a score like any other."""
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(model)
    slots = WordHash()

    def run(batches):
        import pyarrow as pa

        for batch in (own for b in batches for own in slices(b)):
            texts = batch.column("text").to_pylist()
            scores = np.concatenate([held.value.score([features(t, slots) for t in texts[i : i + 256]]) for i in range(0, len(texts), 256)])
            columns = [batch.column(c) for c in carry]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(scores, pa.float64())], [*carry, name])

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(*carry).dtypes)
    return docs.select(*dict.fromkeys([*carry, "text"])).mapInArrow(run, f"{schema}, `{name}` double")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, score, predicted``. Only the text is looked at.

    Null counts as empty; equal texts score alike, also in rows that repeat an id; an empty table gives no rows, and
    no labels give a score of 0.5 to all. Other columns may have any names.
    """
    out = score(docs, learn(docs, labels), ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows that score at least the threshold, with the columns of ``docs``, which may have any names.

    Null counts as empty; rows without an id or with a repeated one are judged by their own text. Empty tables stay empty.
    """
    (name,) = fresh(docs.columns, "score")
    return score(docs, learn(docs, labels), docs.columns, name).filter(F.col(name) >= THRESHOLD).select(*docs.columns)
