"""Secret scans with one combined deterministic automaton.

All rules run in one pass over the bytes of the texts (see ``automaton``). Where
the pass shows that a match of a rule ends, the rule's own automaton finds the
leftmost match around that place and how far it goes; matches of one kind do
not overlap. Checks on a match (length, number of characters of a value) come
after, and a match that fails is passed over whole.

Defined results: null and empty texts have no spans; repeated rows are scanned
alike; places are code points from the start of the text, ends exclusive;
spans of different kinds may overlap; further columns are not read; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tabweave.llm import words as W
from tabweave.llm.automaton import BREAK, Automaton, Rule, compile_rules, longest, scan
from tabweave.llm.frames import map_arrow, table

# The rules. Patterns of the kinds, in the order in which they are listed.
BASE = ("assign", "access", "hex")
NAME = r"(password|passwd|secret|token|api_?key)"
RULES = [
    Rule("assign", r"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=\-]+""", NAME),
    Rule("access", r"AKIA[A-Z0-9]+"),
    Rule("hex", r"[0-9a-f]{8,}"),  # a run is taken whole, then its length is checked
    Rule("private_key", r"\-\-\-\-\-BEGIN [A-Z ]*PRIVATE KEY\-\-\-\-\-"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+"),
    Rule("slack", r"xox[abprs]\-[A-Za-z0-9\-]+"),
]
# Shortest whole match of a kind.
LEAST = {"access": 20, "hex": 24, "github": 40, "slack": 15}
LEAST_VALUE = 6  # characters of an assigned value
BEFORE_VALUE = re.compile(rb"""[A-Za-z_]+["']?\x20*[:=]\x20*["']?""")

RESULT = ("doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


@cache
def machines() -> tuple[Automaton, list[Automaton]]:
    """The search automaton of all rules and the anchored one of each."""
    return compile_rules(RULES, search=True), [compile_rules([r], search=False) for r in RULES]


def holds(kind: str, match: bytes) -> bool:
    if kind == "assign":
        return len(match) - BEFORE_VALUE.match(match).end() >= LEAST_VALUE
    return len(match) >= LEAST.get(kind, 0)


def spans_of(raw: bytes, ends: np.ndarray, idle: np.ndarray, number: int, anchored: Automaton) -> list[tuple[int, int]]:
    """Leftmost matches of one rule, without overlap, that pass the rule's check.

    ``ends``: bytes of the text at which the pass saw a match of the rule end.
    ``idle[p]``: the last byte up to p after which no match of any rule was
    under way; what ends at p began behind it.
    """
    found, done, k = [], 0, 0
    kind = RULES[number].kind
    while k < len(ends):
        end = int(ends[k])
        for start in range(max(done, int(idle[end]) + 1), end + 1):
            stop = longest(anchored, raw, start)
            if stop > start:
                if holds(kind, raw[start:stop]):
                    found.append((start, stop))
                done = stop
                break
        k = max(k + 1, int(np.searchsorted(ends, done)))
    return found


def scan_texts(column: pa.Array, compiled: tuple[Automaton, list[Automaton]]) -> list[list[tuple[int, str, int]]]:
    """Spans (start, kind, end) of each text, in order of start, then kind."""
    search, anchored = compiled
    data, offsets = W.text_buffer(column)
    rows = len(offsets) - 1
    buffer = np.insert(data, offsets[1:], BREAK) if rows else data  # a break behind every text
    cuts = offsets + np.arange(rows + 1)
    states = scan(search, buffer)
    accepted = search.accepts[states]
    out: list[list] = [[] for _ in range(rows)]
    ends = np.flatnonzero(accepted)
    first = np.searchsorted(ends, cuts)  # ends ascend, so a row's are a slice
    order = {rule.kind: k for k, rule in enumerate(RULES)}
    for row in np.flatnonzero(np.diff(first)).tolist():
        low, high = int(cuts[row]), int(cuts[row + 1]) - 1
        raw = buffer[low:high].tobytes()
        own = ends[first[row]:first[row + 1]] - low
        marks = accepted[own + low]
        quiet = np.where(states[low:high] == 0, np.arange(high - low), -1)
        idle = np.maximum.accumulate(quiet)
        points = np.concatenate(([0], np.cumsum((buffer[low:high] & 0xC0) != 0x80)))
        for number in range(len(RULES)):
            mine = own[(marks >> number) & 1 > 0]
            if len(mine):
                out[row] += [(int(points[a]), RULES[number].kind, int(points[b]))
                             for a, b in spans_of(raw, mine, idle, number, anchored[number])]
        out[row].sort(key=lambda s: (s[0], order[s[1]]))
    return out


def listed(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def find_secrets(docs: DataFrame) -> DataFrame:
    """A row per document: counts of the base kinds, the hash of their spans, and all spans."""
    compiled = machines()  # on the driver; the tables go along with the tasks

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in W.text_parts(batch):
            spans = scan_texts(part.column("text"), compiled)
            base = [[s for s in own if s[1] in BASE] for own in spans]
            counts = {f"n_{k}": pa.array([sum(s[1] == k for s in own) for own in base], pa.int64()) for k in BASE}
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column("doc_id").cast(pa.int64()), **counts,
                "base_sha256": pa.array([hashlib.sha256(listed(own).encode()).hexdigest() for own in base], pa.string()),
                "spans": pa.array([listed(own) for own in spans], pa.string())})

    return map_arrow(docs.select("doc_id", "text"), work, RESULT)


def op8_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return find_secrets(table(spark, folder, "documents"))
