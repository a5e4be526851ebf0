"""Hostile rows: nulls, blanks, ties, repeats, long and odd texts."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
P = "the quick brown fox jumps over the lazy dog while seven wise owls watch from old trees near the river bank today"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))


def rows() -> list[tuple]:
    texts: list[tuple] = [
        (1, P, "en", "a", 1),
        (2, P, "en", "a", 1),
        (2, P, "en", "a", 1),
        (3, P + " extra", "en", "b", 1),
        (4, None, "en", "b", None),
        (5, "", None, None, 0),
        (6, " \t\n ", "fr", None, 3),
        (7, "one", "fr", "c", 3),
        (8, "one two", "fr", "c", 3),
        (None, P, None, "c", 3),
        (None, "null id text of its own with several words in it", "en", "a", 3),
        (9, LONG, "en", "a", len(LONG)),
        (10, "a b c d e a b c d e a b c d e\nsame line\nsame line\n\n#$%", "en", "a", 9),
        (11, "Ünïcödé wörds — naïve café, ÀÉ ß 漢字 😀 end", "de", "d", 9),
        (12, "x" * 5000, "en", "d", 5000),
        (13, "na " * 3000, "en", "d", 9000),
    ]
    texts += [(100 + i, " ".join(f"t{(i * 7 + k * k) % 53}" for k in range(20 + i)), "en", "ab"[i % 2], i) for i in range(40)]
    return texts
