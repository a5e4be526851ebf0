"""Language identification by nearest centroids of TF-IDF n-gram vectors, with rejection by distance."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, keep, map_slices

#: Hash buckets of the character n-grams of 1 to 3 letters.
DIMS = 1 << 13
#: Labelled documents the model is fitted on, in all and of one language, chosen by a hash of the id.
MOST_FIT_DOCS = 12_000
MOST_FIT_PER_LANG = 3_000
#: Languages up to which their shares of the sample are broadcast (one narrow row each); beyond, they meet by shuffle.
MOST_BROADCAST_LANGS = 10_000
#: Centroids of a language, and rounds of clustering.
CENTROIDS = 4
ROUNDS = 8
#: A text is rejected if its cosine to the nearest centroid is below this share of the least cosine seen in fitting
#: among texts of its length class.
REJECT = 0.5
#: Text lengths in n-grams at which the rejection limits change.
LENGTHS = (8, 32, 128, 512)
UNKNOWN = "und"

_fold: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """For every code point its lower-case letter, or zero; built once in a worker from Python's character tables."""
    if "table" not in _fold:
        table = np.zeros(0x110000, dtype=np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _fold["table"] = table
    return _fold["table"]


def counts(text: str | None) -> np.ndarray | None:
    """Hashed n-gram counts of the letters, every other character being a gap; None for a text without a letter."""
    if not text:
        return None
    codes = _letters()[np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)]
    solid = codes != 0
    if not solid.any():
        return None
    # one gap between words, one at each end
    leave = solid.copy()
    leave[1:] |= solid[:-1]
    a = np.concatenate(([np.uint32(0)], codes[leave], np.zeros(int(solid[-1]), np.uint32))).astype(np.uint64)
    one = a * np.uint64(0x9E3779B97F4A7C15)
    two = (one[:-1] ^ (a[1:] * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0xD6E8FEB86659FD93)
    three = (two[:-1] ^ (a[2:] * np.uint64(0x165667B19E3779F9))) * np.uint64(0xA0761D6478BD642F)
    grams = np.concatenate((one[a != 0], two, three)) >> np.uint64(51)
    return np.bincount(grams.astype(np.int64), minlength=DIMS)


class Model:
    """IDF weights, unit centroids with their languages, and rejection limits by length class."""

    def __init__(self, idf: np.ndarray, centroids: np.ndarray, langs: list[str], limits: np.ndarray):
        self.idf, self.centroids, self.langs, self.limits = idf, centroids, langs, limits

    def vectors(self, rows: list[np.ndarray]) -> np.ndarray:
        x = np.log1p(np.asarray(rows, dtype=np.float32)) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, cosine) of each text; no letter, or too far from every centroid: ``und``."""
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        rows = [(k, c) for k, t in enumerate(texts) if (c := counts(t)) is not None]
        if not rows or not self.langs:
            return out
        cosine = self.vectors([c for _, c in rows]) @ self.centroids.T
        best = cosine.argmax(axis=1)
        for (k, c), b, row in zip(rows, best.tolist(), cosine):
            score = float(min(1.0, max(0.0, row[b])))
            limit = self.limits[length_class(int(c.sum()))]
            out[k] = (self.langs[b] if score >= limit else UNKNOWN, score)
        return out


def length_class(n: int) -> int:
    return int(np.searchsorted(LENGTHS, n, "right"))


def _cluster(x: np.ndarray, k: int) -> np.ndarray:
    """Unit centroids by spherical k-means from spread-out seeds."""
    chosen = [0]
    near = x @ x[0]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    c = x[chosen].copy()
    for _ in range(ROUNDS):
        own = (x @ c.T).argmax(axis=1)
        for j in range(len(c)):
            if (own == j).any():
                m = x[own == j].mean(axis=0)
                c[j] = m / max(np.linalg.norm(m), 1e-12)
    return c


def fit_lang(idf: np.ndarray, lang: str, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of one language and, by length class, the least cosine of its texts (two where the class is empty)."""
    model = Model(idf, np.zeros((0, DIMS)), [], np.zeros(0))
    x = model.vectors(rows)
    c = _cluster(x, CENTROIDS)
    cosine, size = (x @ c.T).max(axis=1), np.array([length_class(int(r.sum())) for r in rows])
    least = [cosine[size == k].min() if (size == k).any() else 2.0 for k in range(len(LENGTHS) + 1)]
    return c, np.array(least, dtype=np.float64)  # read back as float64, whatever the cosines are


def training_sample(docs: DataFrame) -> DataFrame:
    """(lang, text) of at most MOST_FIT_PER_LANG documents of a language and about MOST_FIT_DOCS in all.

    Chosen by a hash of the id and text (rows equal in both are chosen together).  Languages are counted first and their
    shares broadcast, so the choice is made in the scan and only chosen texts leave it.
    """
    rows = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod(4) != 2))
    draw = (F.pmod(F.xxhash64(F.lit("langid"), "doc_id", "text"), F.lit(1 << 30)) / float(1 << 30))
    per = keep(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    langs = per.count()
    share = per.select("lang", (F.lit(min(MOST_FIT_PER_LANG, MOST_FIT_DOCS / max(1, langs))) / F.col("n")).alias("share"))
    return rows.join(F.broadcast(share) if langs <= MOST_BROADCAST_LANGS else share, "lang").where(draw < F.col("share")).select("lang", "text")


def fit(docs: DataFrame) -> Model:
    """Fits the model on the bounded sample; one task counts document frequencies, one task a language clusters."""
    sample = training_sample(docs).select("lang", "text").withColumn("n", F.length("text"))

    def vectorise(part: pa.RecordBatch) -> dict[str, list]:
        rows = [(lang, c) for lang, t in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()) if (c := counts(t)) is not None]
        return {"lang": [r[0] for r in rows], "v": [zlib.compress(r[1].astype(np.uint32).tobytes(), 1) for r in rows]}

    vectors = keep(map_slices(sample, vectorise, "lang string, v binary"))

    def frequencies(batches):
        n, df = 0, np.zeros(DIMS, dtype=np.int64)
        for batch in batches:
            for v in batch.column("v").to_pylist():
                df += np.frombuffer(zlib.decompress(v), dtype=np.uint32) > 0
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([df.tobytes()], type=pa.binary())], names=["n", "df"])

    partial = vectors.select("v").coalesce(16).mapInArrow(frequencies, "n long, df binary").collect()  # one row of 64 KB a partition, 16 at most
    n = sum(r["n"] for r in partial)
    df = sum((np.frombuffer(r["df"], dtype=np.int64) for r in partial), np.zeros(DIMS, dtype=np.int64))
    idf = (np.log((1 + n) / (1 + df)) + 1.0).astype(np.float32)

    def cluster(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        c, least = fit_lang(idf, key[0], [np.frombuffer(zlib.decompress(v), dtype=np.uint32) for v in group["v"]])
        return pd.DataFrame({"lang": [key[0]], "c": [c.astype(np.float32).tobytes()], "least": [least.tobytes()]})

    fitted = sorted(vectors.groupBy("lang").applyInPandas(cluster, "lang string, c binary, least binary").collect(), key=lambda r: r["lang"])
    centroids, langs = [], []
    limits = np.full(len(LENGTHS) + 1, 2.0)
    for r in fitted:
        own = np.frombuffer(r["c"], dtype=np.float32).reshape(-1, DIMS)
        centroids.append(own)
        langs += [r["lang"]] * len(own)
        limits = np.minimum(limits, np.frombuffer(r["least"], dtype=np.float64))
    known = limits[limits <= 1.0]
    limits = np.where(limits <= 1.0, limits, known.min() if len(known) else 0.0) * REJECT
    return Model(idf, np.concatenate(centroids) if centroids else np.zeros((0, DIMS), dtype=np.float32), langs, limits)


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs``, learned from ``docs`` itself.

    Texts that are null or have no letter are ``und`` with score zero; without labelled documents every text is
    ``und``; texts of any length are read whole; repeated rows are judged alike; an empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(part: pa.RecordBatch) -> dict[str, list]:
        got = model.value.predict(part.column("text").to_pylist())
        return {"doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "lang_pred": [g[0] for g in got], "score": [g[1] for g in got]}

    narrow = docs.select("doc_id", F.coalesce(crc_mod(4) == 2, F.lit(False)).alias("held_out"), "text")
    return map_slices(narrow, run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
