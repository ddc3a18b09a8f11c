"""Counts over one text, as bytes; shared by the quality rules and the quality classifier."""

from __future__ import annotations

import numpy as np

from loomlog.session import ship_by_value

ship_by_value(__name__)

SPACE = b" \t\n\x0b\x0c\r"  # fixed value: what bytes.split() splits at
SYMBOLS = b"#*$%&|<>"  # fixed value
WINDOW = 5


def repeat_words(words: list[bytes]) -> int:
    """Words inside windows of five words that occur twice or more in the text, the first occurrence included.

    Windows become exact ranks, two words at a time; hashes are used only to see that nothing repeats.
    """
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))
    with np.errstate(over="ignore"):
        rough = ids[:n].copy()
        for i in range(1, WINDOW):
            rough = rough * np.int64(0x2545F4914F6CDD1D) + ids[i : i + n] * np.int64(0x9E3779B1)
    rough.sort()
    if not (rough[1:] == rough[:-1]).any():
        return 0
    rank = ids[:n]
    for i in range(1, WINDOW):
        _, rank = np.unique(rank * len(names) + ids[i : i + n], return_inverse=True)
    again = np.bincount(rank)[rank] > 1
    covered = np.zeros(len(words) + 1, np.int64)
    begins = np.flatnonzero(again)
    np.add.at(covered, begins, 1)
    np.add.at(covered, begins + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(covered)[:-1] > 0))


def duplicate_lines(data: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    if b"\n" not in data:
        return 0
    lines = [line for line in data.split(b"\n") if line and not line.isspace()]
    return len(lines) - len(set(lines))


def rule_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    if not text:
        return 0, 0, 0, 0, 0
    data = text.encode()
    words = data.split()
    spaces = len(data) - len(data.translate(None, SPACE))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    return len(words), len(text) - spaces, symbols, duplicate_lines(data), repeat_words(words)
