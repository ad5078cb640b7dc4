"""String similarity by the longest common subsequence, bit-parallel, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence (Hyyrö's bit-vector form)."""
    if len(a) > len(b):
        a, b = b, a
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & masks.get(c, 0)
        s = (s + u | s - u) & full
    return len(a) - s.bit_count()


def ratio(a: str, b: str) -> float:
    """100 * (1 - insertions and deletions / both lengths); 0 if either is empty."""
    return 200.0 * common(a, b) / (len(a) + len(b)) if a and b else 0.0


def token_set_ratio(a: str, b: str) -> float:
    """Similarity of the sets of words: 100 where one holds the other, else the best of the shared words against each
    whole and of the two wholes."""
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    shared = left & right
    if shared and (left <= right or right <= left):
        return 100.0
    one, two = " ".join(sorted(left - right)), " ".join(sorted(right - left))
    both = len(" ".join(sorted(shared)))
    gap = 1 if both else 0
    n1, n2 = both + gap + len(one), both + gap + len(two)
    edits = len(one) + len(two) - 2 * common(one, two)
    best = 100.0 * (1 - edits / (n1 + n2))
    if both:
        best = max(best, 100.0 * (1 - (gap + len(one)) / (both + n1)), 100.0 * (1 - (gap + len(two)) / (both + n2)))
    return best


def _bigrams(text: str) -> list[tuple[str, int]]:
    """The pairs of letters of the text's words in order, repeats numbered."""
    text = " ".join(sorted(set(text.split())))
    seen: dict[str, int] = {}
    out = []
    for i in range(len(text) - 1):
        g = text[i : i + 2]
        seen[g] = seen.get(g, 0) + 1
        out.append((g, seen[g]))
    return out


class Candidates:
    """The choices that a text can reach a score of `least` with, by token_set_ratio: those that share a word, and
    those of about its length that share as many pairs of letters as so similar texts must."""

    def __init__(self, choices: list[str], least: float):
        self.spare = 1 - least / 100
        self.size = np.array([len(" ".join(sorted(set(c.split())))) for c in choices])
        words: dict[str, list[int]] = {}
        pairs: dict[tuple[str, int], list[int]] = {}
        for i, choice in enumerate(choices):
            for w in set(choice.split()):
                words.setdefault(w, []).append(i)
            for g in _bigrams(choice):
                pairs.setdefault(g, []).append(i)
        self.words = {w: np.array(x) for w, x in words.items()}
        self.pairs = {g: np.array(x) for g, x in pairs.items()}

    def of(self, text: str) -> list[int]:
        """Their positions, in order."""
        n, keep = len(" ".join(sorted(set(text.split())))), np.zeros(len(self.size), bool)
        shared = np.zeros(len(self.size), np.int64)
        for g in _bigrams(text):
            if g in self.pairs:
                shared[self.pairs[g]] += 1
        edits = self.spare * (n + self.size) + 1e-9
        # an insertion spoils one pair of letters and a deletion two, and there are no more insertions than half the edits
        keep = (np.abs(self.size - n) <= edits) & (shared >= np.minimum(self.size, n) - 1 - 1.5 * edits)
        for w in set(text.split()):
            if w in self.words:
                keep[self.words[w]] = True
        return np.flatnonzero(keep).tolist()


def best_match(text: str, choices: list[str], scorer: Callable[[str, str], float], least: float, only: Iterable[int] | None = None) -> tuple[int, float] | None:
    """Position and score of the best choice of at least `least`; of equals the first. `only` are the positions to try, in order."""
    top, score = -1, least
    for i in range(len(choices)) if only is None else only:
        if (now := scorer(text, choices[i])) > score or (top < 0 and now == score):
            top, score = i, now
            if score >= 100.0:
                break
    return (top, score) if top >= 0 else None
