"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

Kernel: gap-weighted subsequences of three letters inside a word (its ends are letters too), each step at most GAP
letters long, discounted by DECAY for every letter skipped; a word's features are divided by the norm that its length
gives.  So ``idiot``, ``i.d.i.o.t`` and ``idxiot`` stay close.  The machine is trained in the span of landmark words;
its weights fold back into one table over subsequences, so scoring a text is a table look-up for each position and gap.

A document is labelled, not its words.  Training alternates: the words that speak most for toxicity in toxic documents
are positive, words of other documents, the hardest above all, are negative.  A logistic layer turns a document's
highest word scores into a probability.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod, keep, map_slices

ORDER = 3
GAP = 3
DECAY = 0.55
#: Slots of the subsequence table: one for each three letter classes of six bits.
SLOTS = 1 << 18
LANDMARKS = 320
ROUNDS = 5
#: Labelled documents that the machine is fitted on, and bytes of their texts, in all; half of each for each label.
#: Chosen by a hash of the id.
MOST_FIT_DOCS = 5_000
MOST_FIT_BYTES = 64 << 20
#: Negative words of one round.
NEGATIVES = 9_000
#: Highest word scores of a document that the logistic layer reads.
TOP = 3

_STEPS = [(a, b, DECAY ** (a + b - 2)) for a in range(1, GAP + 1) for b in range(1, GAP + 1)]
_tables: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """Code point to letter class: 0 separates words, 1 is dropped, 2-27 are a-z, the rest fold other letters and digits."""
    if "codes" not in _tables:
        t = np.ones(0x110000, dtype=np.uint8)
        for c in range(0x3000):
            ch = chr(c).lower()[0]
            if ch.isspace():
                t[c] = 0
            elif "a" <= ch <= "z":
                t[c] = ord(ch) - 95
            elif ch.isdigit():
                t[c] = 28
            elif ch.isalpha():
                t[c] = 29 + ord(ch) % 34
        t[0x3000:] = 29 + np.arange(0x3000, 0x110000) % 34
        _tables["codes"] = t
    return _tables["codes"]


def word_codes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Letter classes of the words with an end mark (63) on both sides, and each word's start; marks inside words are
    dropped and runs of single letters are joined."""
    codes = _letters()[np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)]
    codes = codes[codes != 1]
    codes = np.concatenate((np.zeros(1, np.uint8), codes, np.zeros(1, np.uint8)))
    gap = codes == 0
    codes = codes[~(gap & np.concatenate(([False], gap[:-1])))]
    at = np.flatnonzero(codes == 0)
    if len(at) < 2:
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    single = np.diff(at) == 2
    join = at[1:-1][single[:-1] & single[1:]]
    if len(join):
        codes = np.delete(codes, join)
        at = np.flatnonzero(codes == 0)
    # every gap becomes the end of one word and the start of the next
    codes = np.insert(codes, at[1:-1], 0)
    starts = at[:-1] + np.arange(len(at) - 1)
    codes[codes == 0] = 63
    return codes, starts


def _norm(length: np.ndarray) -> np.ndarray:
    """The feature norm of a word of so many letters, were its subsequences all different."""
    total = np.zeros(len(length))
    for a, b, w in _STEPS:
        total += np.maximum(length - a - b, 0) * w * w
    return np.sqrt(np.maximum(total, 1e-9))


def _slots(codes: np.ndarray, a: int, b: int) -> np.ndarray:
    c = codes.astype(np.uint32)
    n = len(c) - a - b
    return c[:n] << 12 | c[a : a + n] << 6 | c[a + b :]


def subsequences(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, slot, weight) of every subsequence, unit norm for each word."""
    lengths = np.diff(np.append(starts, len(codes)))
    word = np.repeat(np.arange(len(starts)), lengths)
    scale = 1.0 / _norm(lengths)
    out = []
    for a, b, w in _STEPS:
        n = len(codes) - a - b
        if n > 0:
            inside = np.flatnonzero(word[:n] == word[a + b :])
            out.append((word[inside], _slots(codes, a, b)[inside], w * scale[word[inside]]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*out))


def word_scores(text: str | None, table: np.ndarray, bias: float) -> np.ndarray:
    """The machine's margin for every word of the text."""
    codes, starts = word_codes(text or "")
    if not len(starts):
        return np.zeros(0)
    lengths = np.diff(np.append(starts, len(codes)))
    total = np.zeros(len(codes), dtype=np.float32)
    ends = np.repeat(starts + lengths, lengths)
    for a, b, w in _STEPS:
        n = len(codes) - a - b
        if n > 0:
            got = table[_slots(codes, a, b)]
            got[ends[:n] - np.arange(n) <= a + b] = 0
            total[:n] += np.float32(w) * got
    return np.add.reduceat(total, starts) / _norm(lengths) + bias


def top_scores(scores: np.ndarray) -> np.ndarray:
    """The TOP highest margins, a text of fewer words being filled up with low ones."""
    out = np.full(TOP, -2.0)
    if len(scores):
        best = np.sort(np.partition(scores, max(0, len(scores) - TOP))[-TOP:])[::-1]
        out[: len(best)] = np.maximum(best, -2.0)
    return out


class Model:
    """Subsequence table, bias, and the logistic layer over the top scores."""

    def __init__(self, table: np.ndarray, bias: float, layer: np.ndarray):
        self.table, self.bias, self.layer = table, bias, layer

    def score(self, text: str | None) -> float:
        x = top_scores(word_scores(text, self.table, self.bias))
        return float(1.0 / (1.0 + np.exp(-np.clip(x @ self.layer[:-1] + self.layer[-1], -30, 30))))


def _svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 20.0, steps: int = 25) -> np.ndarray:
    """Weights and bias of the squared-hinge machine, by Newton steps on the support vectors."""
    x = np.hstack([z, np.ones((len(z), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(steps):
        active = y * (x @ w) < 1
        xa, wa = x[active], weight[active]
        new = np.linalg.solve(ridge + c * (xa.T * wa) @ xa, c * (xa.T * wa) @ y[active])
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x.T * np.maximum(p * (1 - p), 1e-6)) @ x + ridge * np.eye(x.shape[1])
        w -= np.linalg.solve(h, x.T @ (p - y) + ridge * w)
    return w


def _words_of(texts: list[str]) -> tuple[list[bytes], list[np.ndarray]]:
    """Different words (as letter classes) and each text's words as indices."""
    index: dict[bytes, int] = {}
    rows = []
    for text in texts:
        codes, starts = word_codes(text)
        pieces = [p.tobytes() for p in np.split(codes, starts[1:])] if len(starts) else []
        rows.append(np.unique(np.fromiter((index.setdefault(p, len(index)) for p in pieces), dtype=np.int64, count=len(pieces))))
    return list(index), rows


class Landmarks:
    """The landmark words' features over the slots that they have: ``rows[column[slot]]`` holds a slot's weight in each."""

    def __init__(self, words: list[bytes]):
        codes, starts = np.frombuffer(b"".join(words), dtype=np.uint8), np.cumsum([0, *map(len, words[:-1])])
        word, slot, weight = subsequences(codes, starts)
        self.slots, place = np.unique(slot, return_inverse=True)
        self.rows = np.zeros((len(self.slots) + 1, len(words)), dtype=np.float32)  # the last row is every other slot's
        np.add.at(self.rows, (place, word), weight)
        self.column = np.full(SLOTS, len(self.slots), dtype=np.int32)
        self.column[self.slots] = np.arange(len(self.slots))

    def gram(self) -> np.ndarray:
        return (self.rows.T @ self.rows).astype(np.float64)

    def folded(self, beta: np.ndarray) -> np.ndarray:
        """The machine's weight of every slot, given the landmarks' weights."""
        table = np.zeros(SLOTS, dtype=np.float32)
        table[self.slots] = self.rows[:-1] @ beta
        return table


def kernel(words: list[bytes], landmarks: Landmarks, step: int = 2000) -> np.ndarray:
    """Kernel of many words with the landmarks."""
    out = np.zeros((len(words), landmarks.rows.shape[1]), dtype=np.float32)
    for at in range(0, len(words), step):
        part = words[at : at + step]
        codes, starts = np.frombuffer(b"".join(part), dtype=np.uint8), np.cumsum([0, *map(len, part[:-1])])
        word, slot, weight = subsequences(codes, starts)
        order = np.argsort(word, kind="stable")
        word, slot, weight = word[order], slot[order], weight[order].astype(np.float32)
        if len(word):
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            out[at + word[first]] = np.add.reduceat(landmarks.rows[landmarks.column[slot]] * weight[:, None], first, axis=0)
    return out


def _all_scores(words: list[bytes], table: np.ndarray, bias: float, step: int = 50_000) -> np.ndarray:
    out = np.zeros(len(words))
    for at in range(0, len(words), step):
        part = words[at : at + step]
        codes, starts = np.frombuffer(b"".join(part), dtype=np.uint8), np.cumsum([0, *map(len, part[:-1])])
        word, slot, weight = subsequences(codes, starts)
        out[at : at + len(part)] = np.bincount(word, weights=weight * table[slot], minlength=len(part)) + bias
    return out


def train(texts: list[str], labels: np.ndarray, prior: float | None = None) -> Model:
    """Fits the machine on documents with labels 0 and 1; without both labels every score is the label's share.

    ``prior`` is the share of label 1 among all labelled rows, where the documents are a sample that evens out the
    labels; the logistic layer's intercept is moved from the sample's odds to these."""
    labels = labels.astype(int)
    share = float(labels.mean()) if len(labels) else 0.0
    flat = Model(np.zeros(SLOTS, dtype=np.float32), 0.0, np.append(np.zeros(TOP), np.log((share + 1e-3) / (1 - share + 1e-3))))
    if len(labels) < 4 or labels.min() == labels.max():
        return flat
    words, rows = _words_of(texts)
    if not words:
        return flat
    n = len(words)
    df = [np.bincount(np.concatenate([r for r, y in zip(rows, labels) if y == k] or [np.zeros(0, np.int64)]), minlength=n) for k in (0, 1)]
    docs = [max(1, int((labels == k).sum())) for k in (0, 1)]
    # log-odds that a word's document is toxic, shrunk towards none
    odds = np.log((df[1] + 0.5) / (docs[1] + 1)) - np.log((df[0] + 0.5) / (docs[0] + 1))
    evidence = odds * np.minimum(df[1], 6)
    rng = np.random.default_rng(11)
    ranked = np.argsort(-evidence, kind="stable")
    usual = np.flatnonzero(df[0] > 0)
    often = usual[np.argsort(-df[0][usual], kind="stable")[: LANDMARKS // 4]]
    landmark_ids = np.unique(np.concatenate((ranked[: LANDMARKS // 2], often, rng.choice(usual, min(len(usual), LANDMARKS // 4), replace=False) if len(usual) else usual)))
    landmarks = Landmarks([words[k] for k in landmark_ids])
    values, vectors = np.linalg.eigh(landmarks.gram())
    good = values > 1e-6 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])  # Nyström map: kernel row times this
    toxic_rows = [r for r, y in zip(rows, labels) if y == 1 and len(r)]
    clean_rows = [r for r, y in zip(rows, labels) if y == 0 and len(r)]
    current = evidence.astype(float)
    bias, table = 0.0, np.zeros(SLOTS, dtype=np.float32)
    mapped, mapped_row = np.zeros((0, root.shape[1])), np.full(n, -1)  # words come back in later rounds

    def in_span(ids: np.ndarray) -> np.ndarray:
        nonlocal mapped
        fresh = ids[mapped_row[ids] < 0]
        mapped_row[fresh] = len(mapped) + np.arange(len(fresh))
        mapped = np.concatenate((mapped, kernel([words[j] for j in fresh], landmarks) @ root))
        return mapped[mapped_row[ids]]

    for k in range(ROUNDS):
        # witnesses: each toxic document's words that speak most for it and are rare elsewhere
        rare = odds > np.log(4)
        picked = []
        for r in toxic_rows:
            r = r[rare[r]]
            if len(r):
                top = r[np.argsort(-(current[r] + (0 if k == 0 else 0.02 * evidence[r])), kind="stable")[:2]]
                picked.append(top if k == 0 else top[(current[top] > -0.3) | (np.arange(len(top)) == 0)])
        if picked:
            positive, times = np.unique(np.concatenate(picked), return_counts=True)
        else:  # no word speaks for its document: the likeliest stand in
            positive, times = ranked[:50], np.ones(len(ranked[:50]))
        if k == 0:
            strong = df[1][positive] >= 3
            if strong.sum() >= 20:
                positive, times = positive[strong], times[strong]
        hard = np.unique(np.array([r[np.argmax(np.where(df[0][r] > 0, current[r], -9))] for r in clean_rows], dtype=np.int64))
        others = usual[~np.isin(usual, positive)]
        draw = rng.choice(others, min(len(others), NEGATIVES - min(len(hard), NEGATIVES // 2)), replace=False)
        negative = np.setdiff1d(np.unique(np.concatenate((hard, draw))), positive)
        ids = np.concatenate((positive, negative))
        y = np.concatenate((np.ones(len(positive)), -np.ones(len(negative))))
        weight = np.concatenate((np.minimum(times, 20) / max(1, times.sum()), (1 + np.log1p(df[0][negative])) / max(1.0, (1 + np.log1p(df[0][negative])).sum()))) * len(ids) / 20
        w = _svm(in_span(ids), y, weight)
        table, bias = landmarks.folded(root @ w[:-1]), float(w[-1])
        current = _all_scores(words, table, bias)
    x = np.array([top_scores(word_scores(t, table, bias)) for t in texts])
    layer = _logistic(x, labels)
    if prior is not None:
        layer[-1] += np.log(prior / (1 - prior)) - np.log(share / (1 - share))
    return Model(table, bias, layer)


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic, known) of at most about MOST_FIT_DOCS labelled documents of at most MOST_FIT_BYTES in all that are not
    held out, half of each label if there are.

    An id with both labels is toxic; a repeated id is one document, with its least text.  ``known`` is how many labelled
    ids have the row's label.  Ids are chosen by a hash over the narrow label table; only the chosen documents' texts are
    gathered, and of these the first in the hash's order that fit."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_mod(5) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    per = known.groupBy("toxic").agg(F.count(F.lit(1)).alias("known")).withColumn("share", F.least(F.lit(1.0), F.lit(MOST_FIT_DOCS / 2.0) / F.col("known")))
    draw = F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = known.join(F.broadcast(per), "toxic").where(draw < F.col("share")).select("doc_id", "toxic", "known")  # two labels, so MOST_FIT_DOCS rows or so
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = keep(texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic", "known").agg(F.min("text").alias("text")))
    sizes = found.select("doc_id", "toxic", F.octet_length("text").alias("size"))
    upto = F.sum("size").over(Window.partitionBy("toxic").orderBy(draw, "doc_id"))
    fits = sizes.withColumn("upto", upto).where(F.col("upto") <= MOST_FIT_BYTES // 2).select("doc_id")
    return found.join(F.broadcast(fits), "doc_id", "left_semi").select("text", "toxic", "known")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits in one task over the bounded sample; the fitted tables (a few hundred KB) come to the driver."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["toxic", "text"])
        known = group.groupby("toxic")["known"].first()
        prior = known.get(1, 0) / known.sum() if len(known) == 2 else None
        m = train(group["text"].tolist(), group["toxic"].to_numpy(), prior)
        return pd.DataFrame({"t": [m.table.tobytes()], "bias": [m.bias], "layer": [m.layer.astype(np.float64).tobytes()]})

    rows = keep(training_rows(docs, labels)).groupBy().applyInPandas(run, "t binary, bias double, layer binary").collect()
    if not rows:
        return train([], np.zeros(0))
    return Model(np.frombuffer(rows[0]["t"], dtype=np.float32), rows[0]["bias"], np.frombuffer(rows[0]["layer"], dtype=np.float64))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    Null, empty and wordless texts get the score of a text without toxic words; without labels of both kinds every
    score is the share of toxic labels (zero without any).  Repeated rows score alike; an empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(part: pa.RecordBatch) -> dict[str, list]:
        got = [model.value.score(t) for t in part.column("text").to_pylist()]
        return {"doc_id": part.column("doc_id"), "held_out": part.column("held"), "score": got, "predicted": [int(s >= 0.5) for s in got]}

    narrow = docs.select("doc_id", F.coalesce(crc_mod(5) == 0, F.lit(False)).alias("held"), "text")
    return map_slices(narrow, run, f"doc_id {kind}, held_out boolean, score double, predicted int")
