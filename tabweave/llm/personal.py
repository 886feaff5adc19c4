"""Personal data: fixed patterns, and a semi-Markov conditional random field.

Base spans come from fixed patterns. Around digits and at signs the random
field (see ``semicrf``) chooses boundaries and types of further entities
jointly; its spans that overlap no base span are added.

The field is trained here, on a bounded sample: the first ``TRAIN`` documents
with a base span by a hash, and of all their pieces the first ``EACH`` of every
kind by a hash. They give stretches with the base spans as entities, copies in
which the marks that the patterns hang on are dropped or varied (a phone number
without its plus or country, "(at)" for the at sign), copies with harmless
numbers in their place, and stretches without any. The model has a fixed size
and goes along with the tasks.

Only stretches of text around digits and at signs are cut into tokens, so long
texts cost little more than their bytes. A stretch begins and ends at white
space and has any length; nothing inside it is cut.

Defined results: null and empty texts have no spans; repeated rows are judged
alike; places are code points, ends exclusive; base spans of different kinds
may overlap; further columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabweave.llm import words as W
from tabweave.llm.frames import map_arrow, table
from tabweave.llm.semicrf import KINDS, SemiCrf, Stretch, luhn, stretch_of

TRAIN = 200  # documents
EACH = 30  # pieces of a kind
PIECE = 160  # characters of a piece without a base span; longer base spans are no examples
WIDE = 24  # characters of context on both sides, and on to the next white space

# The patterns, fixed values. Possessive repeats and the look behind only spare
# places where a match cannot begin; results are those of the plain patterns.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

RESULT = ("doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
MARK = re.compile(r"[0-9]+|@|\(at\)")
SPACE = re.compile(r"\s")


def emails(text: str) -> list[tuple[int, int]]:
    """Around each at sign: the local part back to the last match, the domain ahead."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
            done = found.end()
        else:
            done = max(done, at + 1) if start == at else done
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """Spans of the four kinds in order of start, then kind."""
    out = [(a, "email", b) for a, b in emails(text)] if "@" in text else []
    out += [(m.start(), "ip", m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p[-3:]) < 256 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), "card", m.end()))
    if "+" in text:
        out += [(m.start(), "phone", m.end()) for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[1])))


def stretches(text: str) -> list[tuple[int, int]]:
    """Parts of the text around digits and at signs, from white space to white space."""
    out: list[list[int]] = []
    for m in MARK.finditer(text):
        floor = out[-1][1] if out else 0
        low = max(floor, m.start() - WIDE)
        while low > floor and not text[low - 1].isspace():
            low -= 1
        if not out or low > floor:
            out.append([low, floor])
        if m.end() + WIDE > out[-1][1]:
            end = SPACE.search(text, m.end() + WIDE)
            out[-1][1] = end.start() if end else len(text)
    return [(a, b) for a, b in out]


def entities(text: str, crf: SemiCrf, base: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """Entities of the field that overlap no base span."""
    out, ahead, reached = [], 0, 0  # base spans before ``ahead`` end by ``reached``
    for low, high in stretches(text):
        for start, end, kind in crf.best_spans(text[low:high]):
            a, b = low + start, low + end
            while ahead < len(base) and base[ahead][0] < b:
                reached = max(reached, base[ahead][2])
                ahead += 1
            if reached <= a:
                out.append((a, KINDS[kind], b))
    return out


def _example(text: str, spans: list[tuple[int, str, int]]) -> tuple[Stretch, set]:
    stretch = stretch_of(text)
    first = {s: k for k, s in enumerate(stretch.starts)}
    last = {e: k + 1 for k, e in enumerate(stretch.ends)}
    gold = {(first[a], last[b], KINDS.index(kind)) for a, kind, b in spans if a in first and b in last}
    held = {(i, j) for i, j, _ in stretch.spans}
    return stretch, {g for g in gold if g[:2] in held}


def variants(kind: str, span: str) -> list[str]:
    """The same entity as people write it who leave out or change its marks."""
    if kind == "email":
        local, _, domain = span.rpartition("@")
        plain = re.sub(r"[^A-Za-z]", "", local) or "x"
        short = ".".join(domain.split(".")[-2:])
        dotted, bare = f"{plain}.{plain[::-1]}", re.sub(r"[0-9]", "", domain).strip(".-") or "x.y"
        return [f"{name}(at){host}" for name, host in (
            (local, domain), (plain, bare), (dotted, bare), (plain, short), (dotted, short), (local, short))]
    if kind == "phone":
        groups = re.findall(r"[0-9]+", span)
        rest = groups[1:] if len(groups) > 2 else groups
        return [span[1:], " ".join(groups), "-".join(rest), " ".join(rest), f"0{rest[0]} {''.join(rest[1:])}"]
    return []


def harmless(span: str) -> list[str]:
    """What may stand in the place of an entity and is none: a short number, too many digits, a date, a mark alone."""
    digits = re.sub(r"[^0-9]", "", span)
    return [digits[:5], (digits * 3)[:24], f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}" if len(digits) > 7 else "none (at) all"]


def examples(text: str) -> Iterator[tuple[Stretch, set]]:
    """Training stretches of one text, with varied copies."""
    base = base_spans(text)
    if not base:
        yield _example(text, [])
    single = [s for k, s in enumerate(base) if not any(s[0] < e[2] and e[0] < s[2] for q, e in enumerate(base) if q != k)]
    for a, kind, b in single:
        low, high = max(0, a - WIDE), min(len(text), b + WIDE)
        part = text[low:high]
        inside = [(s - low, k, e - low) for s, k, e in single if low <= s and e <= high]
        yield _example(part, inside)
        span = text[a:b]
        for other in variants(kind, span):
            yield _example(text[low:a] + other + text[b:high], [(a - low, kind, a - low + len(other))])
        for other in harmless(span):
            yield _example(text[low:a] + other + text[b:high], [])


def pieces(text: str, base: list[tuple[int, str, int]]) -> list[tuple[str, str]]:
    """Training pieces of one text with their kind: the surroundings of every
    base span, and every stretch that has none, in runs of ``PIECE`` characters."""
    out = [(kind, text[max(0, a - 3 * WIDE):b + 3 * WIDE]) for a, kind, b in base if b - a <= PIECE]
    ahead = 0
    for a, b in stretches(text):
        while ahead < len(base) and base[ahead][2] <= a:
            ahead += 1
        if ahead == len(base) or base[ahead][0] >= b:
            out += [("none", text[i:min(b, i + PIECE)]) for i in range(a, b, PIECE)]
    return out


def train(docs: DataFrame, limit: int = TRAIN, each: int = EACH) -> SemiCrf:
    """Fit the field on at most ``limit`` documents with a base span, and at
    most ``each`` of their pieces per kind, the first by their hash."""
    key = F.xxhash64(F.col("doc_id"), F.col("text")).alias("key")

    def mark(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = [bool(base_spans(t.as_py())) for t in batch.column("text")]
        yield pa.RecordBatch.from_pydict({"key": batch.column("key").filter(pa.array(found, pa.bool_()))})

    marked = map_arrow(docs.where(F.col("text").rlike("[0-9@]")).select(key, "text"), mark, "key long")
    # only hashes meet in one task; whole texts stay where they are read, the driver gets the pieces chosen
    first = F.broadcast(marked.distinct().orderBy("key").limit(limit))  # at most ``limit`` rows
    picked = docs.select(key, "text").join(first, "key", "left_semi")

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for text in batch.column("text"):
            own = pieces(text.as_py(), base_spans(text.as_py()))
            yield pa.RecordBatch.from_pydict({"kind": pa.array([k for k, _ in own], pa.string()),
                                              "piece": pa.array([p for _, p in own], pa.string())})

    order = Window.partitionBy("kind").orderBy(F.xxhash64("piece"), "piece")  # cut off before the shuffle as well
    cuts = map_arrow(picked, cut, "kind string, piece string").distinct().withColumn("place", F.row_number().over(order))
    rows = cuts.where(F.col("place") <= each).select("piece").distinct().collect()
    return SemiCrf().train([e for p in sorted(r["piece"] for r in rows) for e in examples(p)])


def listed(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def find_personal(docs: DataFrame, crf: SemiCrf | None = None) -> DataFrame:
    """A row per document: counts of the base kinds, the hash of their spans, and all spans."""
    weights = (crf or train(docs)).weights.astype(np.float32)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        model = SemiCrf(weights)
        for part in W.text_parts(batch):
            data, offsets = W.text_buffer(part.column("text"))
            marked = W.segment_sums((data >= 48) & (data <= 57) | (data == 64) | (data == 43), offsets) > 0
            marked |= np.asarray(pc.fill_null(pc.match_substring(part.column("text"), "(at)"), False))
            base, every = [], []
            texts = part.column("text")
            for row, has in enumerate(marked.tolist()):
                text = texts[row].as_py() if has else ""
                base.append(base_spans(text))
                every.append(sorted(base[-1] + entities(text, model, base[-1]), key=lambda s: (s[0], KINDS.index(s[1]), s[2])))
            counts = {f"n_{k}": pa.array([sum(s[1] == k for s in own) for own in base], pa.int64()) for k in KINDS}
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column("doc_id").cast(pa.int64()), **counts,
                "base_sha256": pa.array([hashlib.sha256(listed(own).encode()).hexdigest() for own in base], pa.string()),
                "spans": pa.array([listed(own) for own in every], pa.string())})

    return map_arrow(docs.select("doc_id", "text"), work, RESULT)


def op10_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return find_personal(table(spark, folder, "documents").select("doc_id", "text"))
