"""Language ID: nearest of several centroids for each language, over hashed character n-grams with TF-IDF weights."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scatterwave.llm.common import arrow_map, held_out, slices
from scatterwave.runtime import broadcast_if_small, ship

SLOTS = 2**13
CENTROIDS = 3
#: Texts that centroids are fitted on, over all languages, and the least for each; document frequencies cover all learning rows.
FIT_ROWS, FIT_LEAST = 4_000, 40
#: A text farther from every centroid than this share of a centroid's own texts is rejected.
REJECT_QUANTILE = 0.002
UNDETERMINED = "und"
#: Characters that are looked at together; arrays of a whole text would take many times its size.
PIECE = 2**20
_GAP = re.compile(r"\s")


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether a code point is a letter, for all of Unicode."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _pieces(text: str):
    """The text in pieces of about ``PIECE`` characters, cut at white space, across which no n-gram reaches."""
    at = 0
    while len(text) - at > PIECE and (gap := _GAP.search(text, at + PIECE)):
        yield text[at : gap.start()]
        at = gap.start()
    yield text[at:]


def ngram_counts(text: str | None) -> np.ndarray | None:
    """Counts of hashed 1- to 3-grams of letters with word boundaries; None for a text that has no letter."""
    total = None
    for piece in _pieces(text or ""):
        own = _piece_counts(piece)
        total = own if total is None else total if own is None else total + own
    return total


def _piece_counts(text: str) -> np.ndarray | None:
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(_letters()[codes], codes, 0).astype(np.int64)
    if not codes.any():
        return None
    before = np.concatenate([[0], codes[:-1]])
    codes = np.concatenate([[0], codes[(codes != 0) | (before != 0)], [0]])
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    mid = b != 0
    a, b, c = a[mid], b[mid], c[mid]
    one, two, three = b * 2654435761, (a * 31 + b + 7) * 2246822519, ((a * 31 + b) * 31 + c + 13) * 3266489917
    return np.bincount(np.concatenate([(h >> 15) & (SLOTS - 1) for h in (one, two, three)]), minlength=SLOTS)


def vector(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts, dtype=np.float32) * idf
    return v / (np.sqrt(np.dot(v, v)) or 1.0)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]  # of each centroid
    centroids: np.ndarray
    limits: np.ndarray  # least cosine that a centroid accepts
    idf: np.ndarray

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """Language, cosine and whether every centroid is too far. No letter: undetermined, zero, rejected."""
        out: list = [(UNDETERMINED, 0.0, True)] * len(texts)
        counts = [ngram_counts(t) for t in texts]
        rows = [i for i, c in enumerate(counts) if c is not None]
        if not rows or not self.languages:
            return out
        cosine = np.stack([vector(counts[i], self.idf) for i in rows]) @ self.centroids.T
        best = cosine.argmax(axis=1)  # ties: the first language by name
        far = (cosine < self.limits).all(axis=1)
        for i, k, row, f in zip(rows, best, cosine, far):
            out[i] = (self.languages[k], float(min(1.0, max(0.0, row[k]))), bool(f))
        return out


def cluster(rows: np.ndarray, k: int = CENTROIDS, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from far-apart starts; centroids and each row's cosine to its own."""
    mean = rows.mean(axis=0)
    centers = [rows[int((rows @ mean).argmax())]]
    while len(centers) < min(k, len(rows)):
        centers.append(rows[int((rows @ np.stack(centers).T).max(axis=1).argmin())])
    c = np.stack(centers)
    for _ in range(rounds):
        own = (rows @ c.T).argmax(axis=1)
        c = np.stack([rows[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c, (rows @ c.T).max(axis=1)


def learn(docs: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Document frequencies from every learning row, centroids from a bounded sample of each language by hash of id."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long"), "lang", "text")

    def frequencies(batches):
        import pyarrow as pa

        total, n = np.zeros(SLOTS, np.int64), 0
        for batch in (own for b in batches for own in slices(b)):
            for text in batch.column("text").to_pylist():
                counts = ngram_counts(text)
                if counts is not None:
                    total += counts > 0
                    n += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], ["slot", "n"])

    df = rows.select("text").mapInArrow(frequencies, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow().to_pandas()  # SLOTS + 1 rows at most
    n = int(df.loc[df["slot"] == -1, "n"].sum())
    count = np.zeros(SLOTS)
    own = df[df["slot"] >= 0]
    count[own["slot"].to_numpy()] = own["n"].to_numpy()
    idf = np.log((1 + n) / (1 + count)).astype(np.float32) + 1.0

    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    languages = sizes.count()
    each = max(FIT_LEAST, fit_rows // max(1, languages))
    # By id and text, and each pair once, so that no repeated id or row can fill the sample.
    rows = rows.withColumn("t", F.xxhash64(F.coalesce("text", F.lit(""))))
    share = F.pmod(F.xxhash64("doc_id", "t", F.lit(11)), F.lit(1_000_000)) / 1e6
    sample = rows.join(broadcast_if_small(sizes, languages, 10_000), "lang").filter(share < F.lit(1.2 * each) / F.col("n")).dropDuplicates(["doc_id", "lang", "t"])

    def vectors(batch):
        import pyarrow as pa

        rows = []
        for i, lang, text in zip(batch["doc_id"], batch["lang"], batch["text"]):
            if (c := ngram_counts(text)) is not None:
                at = np.flatnonzero(c)
                rows.append((i, lang, at.astype(np.int16).tobytes(), c[at].astype(np.int32).tobytes()))
        kinds = {"doc_id": pa.int64(), "lang": pa.string(), "at": pa.binary(), "n": pa.binary()}
        return {c: pa.array([r[k] for r in rows], kind) for k, (c, kind) in enumerate(kinds.items())}

    got = arrow_map(sample.select("doc_id", "lang", "text"), vectors, "doc_id long, lang string, at binary, n binary").toArrow().to_pandas()
    names, centers, limits = [], [np.zeros((0, SLOTS), np.float32)], []
    for lang, part in got.groupby("lang", sort=True):
        part = part.sort_values(["doc_id", "at", "n"])
        m = np.zeros((len(part), SLOTS), np.float32)
        for i, (at, value) in enumerate(zip(part["at"], part["n"])):
            m[i, np.frombuffer(at, np.int16)] = np.frombuffer(value, np.int32)
        c, near = cluster(np.stack([vector(row, idf) for row in m]))
        names += [lang] * len(c)
        centers.append(c.astype(np.float32))
        limits += [float(np.quantile(near, REJECT_QUANTILE)) * 0.8] * len(c)
    return Model(tuple(names), np.concatenate(centers), np.array(limits, np.float32), idf)


def identify(docs: DataFrame, model: Model, reject: bool = True) -> DataFrame:
    """``doc_id, lang_pred, score, rejected`` for every row. ``reject``: rejected texts are undetermined as well.

    Null texts and texts without a letter are undetermined with score 0.
    """
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(model)  # CENTROIDS x SLOTS floats for each language

    def run(batch):
        texts, out = batch["text"], []
        for i in range(0, len(texts), 256):
            out += held.value.predict(texts[i : i + 256])
        return {"doc_id": batch["doc_id"], "lang_pred": [UNDETERMINED if reject and far else lang for lang, _, far in out], "score": [s for _, s, _ in out], "rejected": [far for _, _, far in out]}

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, lang_pred string, score double, rejected boolean")


def digest(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, lang_pred, score, rejected``; lang_pred names the nearest language even where rejected.

    Null and empty texts and those without a letter are undetermined with score 0, and so is every text where nothing
    can be learnt. Ties go to the first language by name. Rows that repeat an id are judged by their own texts. An
    empty table gives no rows. Only doc_id, lang and text are read, so other columns may have any names.
    """
    out = identify(docs, learn(docs), reject=False)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
