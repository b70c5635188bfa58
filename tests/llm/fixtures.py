"""Rows that the tests of the training-data operators share."""

from __future__ import annotations


def prose(seed: int, words: int) -> str:
    import random

    rng = random.Random(seed)
    out = []
    for k in range(words):
        w = "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
        out.append(w + (". " if k % 9 == 8 else " "))
    return "".join(out).strip()


def odd_rows() -> list[tuple]:
    """Nulls in any column, empty and long texts, ties and repeated rows."""
    long = prose(1, 6000)
    return [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (None, "No id here at all.", "en", "a", None),
        (3, long, "en", "b", len(long)),
        (3, long, "en", "b", len(long)),
        (4, prose(2, 80), "fr", None, 1),
        (5, prose(2, 80), "fr", "c", 1),
        (6, "   \n\t\n ", None, "c", 7),
        (7, "one", "xx", "c", 3),
        (8, "é" * 300 + " 中文字 😀", "xx", "c", 3),
    ]
