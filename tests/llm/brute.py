"""Brute-force versions of the operators, over rows held in Python."""

from __future__ import annotations

import hashlib
import re

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def substring_dedup(rows: list[tuple], length: int) -> dict:
    """rows: (doc_id, text); doc_ids differ."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        words = SPACED.findall(text or "")
        removed = [False] * len(words)
        for s in range(len(words) - length + 1):
            window = tuple(words[s:s + length])
            if window in seen:
                removed[s:s + length] = [True] * length
            seen.add(window)
        kept = [w for w, gone in zip(words, removed, strict=True) if not gone]
        out[doc_id] = (len(words), sum(removed), sha(" ".join(kept)))
    return out


LETTERS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text: str | None) -> bytes:
    return (text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)))


def leaks(rows: list[tuple], items: list[tuple], length: int) -> list[tuple]:
    """(doc_id, n_words, n_hit, n_items, sha of items, contaminated) per row."""
    windows: dict[tuple, set] = {}
    for item, text in items:
        words = LETTERS.findall(low(text))
        width = min(length, len(words))
        for s in range(len(words) - width + 1 if words else 0):
            windows.setdefault(tuple(words[s:s + width]), set()).add(item)
    widths = {len(w) for w in windows}
    out = []
    for doc_id, text in rows:
        words = LETTERS.findall(low(text))
        hit, found = set(), set()
        for width in widths:
            for s in range(len(words) - width + 1):
                if (own := windows.get(tuple(words[s:s + width]))) is not None:
                    hit.update(range(s, s + width))
                    found |= own
        names = sorted(str(i) for i in found if i is not None)
        out.append((doc_id, len(words), len(hit), len(names), sha(",".join(names)), bool(hit)))
    return out


def near_dups(rows: list[tuple], per_cent: int = 85, length: int = 5) -> dict:
    """doc_id -> (n_shingles, component_id); doc_ids differ and are given."""
    sets = {}
    for doc_id, text in rows:
        words = SPACED.findall(low(text).decode())
        sets[doc_id] = {tuple(words[s:s + length]) for s in range(max(1, len(words) - length + 1))} if words else set()
    parent = {d: d for d in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders: dict[tuple, list] = {}
    for d, own in sorted(sets.items()):
        shared: dict = {}
        for s in own:
            for e in holders.setdefault(s, []):
                shared[e] = shared.get(e, 0) + 1
            holders[s].append(d)
        for e, both in shared.items():
            if 100 * both >= per_cent * (len(own) + len(sets[e]) - both):
                a, b = top(d), top(e)
                parent[max(a, b)] = min(a, b)
    return {d: (len(own), top(d)) for d, own in sets.items()}


def quality_counts(text: str | None) -> tuple:
    text = text or ""
    words = SPACED.findall(text)
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    windows: dict[tuple, int] = {}
    for s in range(len(words) - 2):
        windows[tuple(words[s:s + 3])] = windows.get(tuple(words[s:s + 3]), 0) + 1
    hit = {p for s in range(len(words) - 2) if windows[tuple(words[s:s + 3])] > 1 for p in range(s, s + 3)}
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit))


def secrets(text: str | None) -> list[tuple[int, str, int]]:
    text = text or ""
    name = r"(?i:(password|passwd|secret|token|api_?key))"
    kinds = {"assign": (name + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
             "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
             "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 24)}
    found = [(m.start(), k, m.end()) for k, (p, ok) in kinds.items() for m in re.finditer(p, text, re.ASCII) if ok(m)]
    return sorted(found, key=lambda s: (s[0], list(kinds).index(s[1])))


def token_rows(rows: list[tuple], path: str) -> list[tuple]:
    """(doc_id, start, n_tokens, crc) in order; doc_ids differ and are given."""
    import struct
    import zlib

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    out, at = [], 0
    for doc_id, text in sorted(rows):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((doc_id, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    return out


def personal(text: str | None) -> list[tuple[int, str, int]]:
    text = text or ""
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
             "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def holds(kind: str, match: str) -> bool:
        digits = [int(c) for c in match if c in "0123456789"]
        if kind == "ip":
            return all(int(p) <= 255 for p in match.split("."))
        if kind == "card":
            twice = sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits[::-1]))
            return 14 <= len(digits) <= 19 and twice % 10 == 0
        return 10 <= len(digits) <= 15 if kind == "phone" else True

    found = [(m.start(), k, m.end()) for k, p in kinds.items() for m in re.finditer(p, text) if holds(k, m[0])]
    return sorted(found, key=lambda s: (s[0], list(kinds).index(s[1])))
