"""Quality rules by compression bands: zstandard ratios of whole documents and of fixed chunks."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names, map_slices, raw

#: zstandard level and chunk length in bytes; a last chunk shorter than LEAST_CHUNK is not judged.
LEVEL = 3
CHUNK = 4096
LEAST_CHUNK = 1024
#: Bands of the ratio bytes / compressed bytes by length in bytes: (from length, lowest, highest).  Short texts carry a
#: frame's overhead, so their bands lie lower; longer texts repeat more words, so theirs lie higher.
BANDS = (
    (0, 0.0, 2.0),
    (128, 0.85, 2.3),
    (256, 1.05, 2.6),
    (512, 1.15, 2.9),
    (1024, 1.25, 3.2),
    (2048, 1.3, 3.5),
    (8192, 1.3, 3.9),
    (32768, 1.3, 4.3),
)
#: A document goes if more than this share of its judged chunk bytes lies outside the band.
MOST_BAD_CHUNKS = 0.5
#: The base rule.
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20

SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\r\x0b\x0c"
CONTINUATION = bytes(range(0x80, 0xC0))
_STARTS = [b[0] for b in BANDS]
#: Odd factors of the window hash.
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words inside windows of ``width`` words that the text holds twice or more (64-bit window hashes)."""
    n = len(words)
    if n <= width or len(set(words)) == n:
        return 0
    h = np.fromiter(map(hash, words), dtype=np.int64, count=n).view(np.uint64)
    windows = h[: n - width + 1] * _FACTORS[0]
    for k in range(1, width):
        windows = windows + (h[k : n - width + 1 + k] ^ (h[k : n - width + 1 + k] >> np.uint64(29))) * _FACTORS[k]
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(windows), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(n + 1, dtype=np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int(np.count_nonzero(np.cumsum(edge[:n])))


def band(length: int) -> tuple[float, float]:
    """The lowest and highest ratio for a text of so many bytes."""
    return BANDS[bisect_right(_STARTS, length) - 1][1:]


def judge(text: bytes, compressor: zstandard.ZstdCompressor) -> tuple[float, float, bool]:
    """Whole ratio, share of judged chunk bytes outside their band, verdict; an empty text passes."""
    n = len(text)
    if not n:
        return 0.0, 0.0, True
    low, high = band(n)
    ratio = n / len(compressor.compress(text))
    bad = judged = 0
    if n > CHUNK:
        for at in range(0, n, CHUNK):
            piece = text[at : at + CHUNK]
            if len(piece) >= LEAST_CHUNK:
                lo, hi = band(len(piece))
                judged += len(piece)
                bad += 0 if lo <= len(piece) / len(compressor.compress(piece)) <= hi else len(piece)
    share = bad / judged if judged else 0.0
    return ratio, share, low <= ratio <= high and share <= MOST_BAD_CHUNKS


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, ratio double, bad_chunk_share double, kept boolean"
_NAMES = [m.split()[0] for m in MEASURES.split(", ")]
_state: dict[str, zstandard.ZstdCompressor] = {}


def measure(text: bytes | None) -> tuple:
    """All MEASURES of one text; null is the text without words."""
    text = text or b""
    compressor = _state.get("z") or _state.setdefault("z", zstandard.ZstdCompressor(level=LEVEL))
    words = text.split()
    n = len(words)
    chars = len(text.translate(None, CONTINUATION)) - (len(text) - len(text.translate(None, BLANKS)))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [line for line in text.split(b"\n") if line.strip()]
    repeats = repeated_words(words)
    failed = n < LEAST_WORDS or 100 * repeats > MOST_REPEATED_PERCENT * n
    ratio, share, fine = judge(text, compressor)
    return n, chars, symbols, len(lines) - len(set(lines)), repeats, failed, ratio, share, fine and not failed


def score_quality(docs: DataFrame, carry: list[str]) -> DataFrame:
    """The MEASURES of every row of ``docs`` beside its columns ``carry``.

    Words are ``[^\\x20\\x09-\\x0D]+``.  A null or empty text has no words and fails the base rule; each row is judged
    alone, so repeated rows and ties are judged alike; an empty table gives no rows; columns of ``docs`` beyond
    ``carry`` are not read, and a column of ``carry`` that bears a measure's name (letter case aside) gives way to it.
    """
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    carry = [c for c in carry if c.lower() not in _NAMES]
    (t,) = free_names([*carry, *_NAMES], "__t")

    def columns(part: pa.RecordBatch) -> dict[str, list]:
        rows = [measure(text) for text in part.column(t).to_pylist()]
        return dict(zip(_NAMES, map(list, zip(*rows)))) | {n: part.column(n) for n in carry}

    narrow = docs.select(*(F.col(f"`{c}`") for c in carry), raw().alias(t))
    return map_slices(narrow, columns, ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), MEASURES]))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with the columns of ``docs`` (one pass, no shuffle)."""

    def run(batches):
        from .common import slices

        for part in slices(batches):
            fine = pa.array([measure(t.encode() if t is not None else None)[-1] for t in part.column("text").to_pylist()], type=pa.bool_())
            if (good := part.filter(fine)).num_rows:
                yield good

    return docs.mapInArrow(run, docs.schema)
