"""A semi-Markov conditional random field over short stretches of tokens.

A segmentation cuts a stretch into outside tokens and entities of up to
``LONGEST`` tokens. Whole-span features score each candidate entity; the
partition sum and the best segmentation come from dynamic programming over
segment ends, with the length of an entity bounded.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np

LONGEST = 14  # tokens of an entity
KINDS = ("email", "ip", "card", "phone")
FEATURES = 1 << 12
# Letters, digits, a lone mark, or white space.
TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^\W\d_]+|\s|.", re.DOTALL)
CUES = ("call", "card", "contact", "e-mail", "email", "fax", "ip", "mail", "mobile", "phone", "server", "tel", "visa")


def tokens_of(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in TOKEN.finditer(text)]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if k % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def shape(span: str) -> str:
    """Runs of digits as d, letters as a, marks as they are."""
    return re.sub(r"[0-9]+", "d", re.sub(r"[^\W\d_]+", "a", span))


def _number(name: str) -> int:
    value = 2166136261
    for c in name.encode():
        value = (value ^ c) * 16777619 & 0xFFFFFFFF
    return value % FEATURES


def span_features(text: str, start: int, end: int) -> list[int]:
    """Numbers of the features of a candidate span, the same for all kinds."""
    span = text[start:end]
    digits = re.sub(r"[^0-9]", "", span)
    marks = "".join(sorted(set(re.sub(r"[\w\s]", "", span))))
    groups = re.findall(r"[0-9]+", span)
    before, after = text[max(0, start - 1):start], text[end:end + 1]
    cue = re.findall(r"[a-z-]+", text[max(0, start - 16):start].lower())[-1:]
    names = [
        "bias", "marks=" + marks, f"digits={min(len(digits), 20)}", "shape=" + shape(span)[:24],
        "first=" + shape(span[0]), "last=" + shape(span[-1]), "glued_before=" + str(bool(before) and before.isalnum()),
        "glued_after=" + str(bool(after) and after.isalnum()), "before=" + shape(before or "^"), "after=" + shape(after or "$"),
        "words=" + str(span.count(" ")), "groups=" + ".".join(str(min(len(g), 5)) for g in groups[:6])]
    if 13 <= len(digits) <= 19:
        names.append("luhn=" + str(luhn(digits)))
    if len(groups) == 4:
        names.append("octets=" + str(all(int(g[:4]) < 256 for g in groups)))
    if cue and cue[0] in CUES:
        names.append("cue=" + cue[0])
    return [_number(n) for n in names]


def may_be_entity(text: str, start: int, end: int) -> bool:
    """Candidates begin and end with a letter, a digit or an opening plus, and
    hold a digit or an at sign; other segments are outside tokens."""
    span = text[start:end]
    if not (span[0].isalnum() or span[0] in "+(") or not span[-1].isalnum():
        return False
    return "@" in span[1:-1] or sum(c.isdigit() for c in span) >= 4 or "(at)" in span


@dataclass
class Stretch:
    """A stretch of text with its tokens and candidate spans."""

    text: str
    ends: list[int]  # tokens
    starts: list[int]
    spans: list[tuple[int, int, np.ndarray]]  # first token, one past the last, features


def stretch_of(text: str) -> Stretch:
    tokens = tokens_of(text)
    spans = []
    for i in range(len(tokens)):
        for j in range(i + 1, min(len(tokens), i + LONGEST) + 1):
            a, b = tokens[i][0], tokens[j - 1][1]
            if may_be_entity(text, a, b):
                spans.append((i, j, np.array(span_features(text, a, b))))
    return Stretch(text, [t[1] for t in tokens], [t[0] for t in tokens], spans)


class SemiCrf:
    """Weights per kind and feature; an outside token scores 0, an entity adds its kind's sum."""

    def __init__(self, weights: np.ndarray | None = None):
        self.weights = np.zeros((len(KINDS), FEATURES)) if weights is None else weights

    def scores(self, stretch: Stretch) -> list[np.ndarray]:
        return [self.weights[:, f].sum(axis=1) for _, _, f in stretch.spans]

    def gradient(self, stretch: Stretch, gold: set[tuple[int, int, int]]) -> tuple[float, list[tuple[np.ndarray, np.ndarray]]]:
        """Log likelihood of the gold entities, and per candidate the gold minus expected count of each kind."""
        n, scores = len(stretch.ends), self.scores(stretch)
        by_end: list[list[int]] = [[] for _ in range(n + 1)]
        by_start: list[list[int]] = [[] for _ in range(n + 1)]
        for k, (i, j, _) in enumerate(stretch.spans):
            by_end[j].append(k)
            by_start[i].append(k)
        total = [np.logaddexp.reduce(s) for s in scores]
        ahead, behind = [0.0] * (n + 1), [0.0] * (n + 1)
        for j in range(1, n + 1):
            ahead[j] = float(np.logaddexp.reduce([ahead[j - 1], *(ahead[stretch.spans[k][0]] + total[k] for k in by_end[j])]))
        for i in range(n - 1, -1, -1):
            behind[i] = float(np.logaddexp.reduce([behind[i + 1], *(behind[stretch.spans[k][1]] + total[k] for k in by_start[i])]))
        likelihood, parts = -ahead[n], []
        for k, (i, j, features) in enumerate(stretch.spans):
            change = -np.exp(ahead[i] + scores[k] + behind[j] - ahead[n])
            for kind in range(len(KINDS)):
                if (i, j, kind) in gold:
                    change[kind] += 1
                    likelihood += scores[k][kind]
            parts.append((features, change))
        return likelihood, parts

    def train(self, examples: list[tuple[Stretch, set]], rounds: int = 8, rate: float = 0.5, decay: float = 1e-3) -> SemiCrf:
        """Stochastic gradient steps with AdaGrad, in the given order."""
        seen = np.full_like(self.weights, 1e-6)
        for _ in range(rounds):
            for stretch, gold in examples:
                for features, change in self.gradient(stretch, gold)[1]:
                    if np.abs(change).max() < 1e-4:
                        continue
                    step = change[:, None] - decay * self.weights[:, features]
                    seen[:, features] += step**2
                    self.weights[:, features] += rate * step / np.sqrt(seen[:, features])
        return self

    def best(self, stretch: Stretch) -> list[tuple[int, int, int]]:
        """Entities (first token, one past the last, kind) of the best segmentation."""
        n, scores = len(stretch.ends), self.scores(stretch)
        by_end: list[list[int]] = [[] for _ in range(n + 1)]
        for k, (_, j, _) in enumerate(stretch.spans):
            by_end[j].append(k)
        value, back = [0.0] * (n + 1), [-1] * (n + 1)
        for j in range(1, n + 1):
            value[j] = value[j - 1]
            for k in by_end[j]:
                score = value[stretch.spans[k][0]] + float(scores[k].max())
                if score > value[j] and math.isfinite(score):
                    value[j], back[j] = score, k
        out, j = [], n
        while j:
            if back[j] < 0:
                j -= 1
                continue
            i, _, _ = stretch.spans[back[j]]
            out.append((i, j, int(scores[back[j]].argmax())))
            j = i
        return out[::-1]

    def best_spans(self, text: str) -> list[tuple[int, int, int]]:
        """``best`` as places in the text (start, end, kind), for texts of any
        length: a candidate's features are dropped once it is scored."""
        tokens = tokens_of(text)
        value, back = [0.0], [None]
        for j in range(1, len(tokens) + 1):
            most, entity = value[-1], None
            b = tokens[j - 1][1]
            if text[b - 1].isalnum():
                for i in range(max(0, j - LONGEST), j):
                    a = tokens[i][0]
                    if may_be_entity(text, a, b):
                        scores = self.weights[:, span_features(text, a, b)].sum(axis=1)
                        score = value[i] + float(scores.max())
                        if score > most and math.isfinite(score):
                            most, entity = score, (i, int(scores.argmax()))
            value.append(most)
            back.append(entity)
        out, j = [], len(tokens)
        while j:
            if back[j] is None:
                j -= 1
                continue
            i, kind = back[j]
            out.append((tokens[i][0], tokens[j - 1][1], kind))
            j = i
        return out[::-1]
