"""URL filter: host word segmentation and naive Bayes.

Rules decide first, the longest that fits. For the other urls, the labels of a
host are split into words by a unigram Viterbi, the path is cut at marks, and a
multinomial naive Bayes over these tokens gives the verdict. It is fitted on the
urls that a rule decides, without the host and path that the rule names (they
would only repeat it), and on hosts with one of a few seed words.

The lexicon holds the words with at least ``WORD_SHARE`` of all words in the
pages' texts, so it has at most ``1 / WORD_SHARE`` words whatever the input.
Tokens are hashed into ``BUCKETS`` numbers, so the model has a fixed size.
Counts cover all pages and are combined before the shuffle; verdicts need no
shuffle.

Defined results: a null url, or one without ``://``, has empty host and path,
no rule, and the verdict of a url without tokens, the more frequent class;
repeated rows are judged alike; null or empty pages add no words; further
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.llm.frames import keep, map_arrow, table

# (verdict, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))
# Words whose hosts count as blocked examples where no rule decides.
SEEDS = ("casino", "cheap", "pills", "porn", "spam", "viagra")
WORD_SHARE = 5e-6
LONGEST_WORD = 24
BUCKETS = 1 << 16
CLASSES = ("allow", "block")

RESULT = "page_id long, host string, path string, rule string, verdict string"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
HOST_END = re.compile(r"[/?#]")
PATH_END = re.compile(r"[?#]")
PARTS = re.compile(r"[a-z]+|[0-9]+|[^a-z0-9\x00-\x7f]+")


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = HOST_END.search(rest)
    host, rest = (rest[:end.start()], rest[end.start():]) if end else (rest, "")
    end = PATH_END.search(rest)
    return host.translate(UPPER), rest[:end.start()] if end else rest


def rule_of(host: str, path: str, rules: tuple = RULES) -> tuple[str, str] | None:
    """Verdict and text of the longest rule that fits."""
    fitting = [(len(h) + len(p), verdict, h + p) for verdict, h, p in rules
               if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fitting)[1:] if fitting else None


@dataclass
class Segmenter:
    """Splits names into words by the most probable sequence of unigrams."""

    words: dict[str, float]  # log probability
    total: float
    memory: dict[str, list[str]] = field(default_factory=dict)

    def split(self, name: str) -> list[str]:
        if name in self.memory:
            return self.memory[name]
        best, cut = [0.0] + [-math.inf] * len(name), [0] * (len(name) + 1)
        for end in range(1, len(name) + 1):
            for start in range(max(0, end - LONGEST_WORD), end):
                word = name[start:end]
                # a word outside the lexicon gets less, the longer it is
                value = best[start] + self.words.get(word, -math.log(self.total) - 2.5 * len(word))
                if value > best[end]:
                    best[end], cut[end] = value, start
        out, end = [], len(name)
        while end:
            out.append(name[cut[end]:end])
            end = cut[end]
        if len(self.memory) > 100_000:
            self.memory.clear()
        if len(name) <= 64:
            self.memory[name] = out[::-1]
        return out[::-1]


def tokens_of(host: str, path: str, segmenter: Segmenter) -> list[str]:
    """Host words and path parts; numbers are one token of their kind. The last
    label of the host is left out: rules that name it would decide all others."""
    out = []
    for side, text in (("h", host.rpartition(".")[0]), ("p", path.translate(UPPER))):
        for part in PARTS.findall(text):
            if part[0].isdigit():
                out.append(f"{side}:#")
            elif side == "h":
                out += [f"h:{w}" for w in segmenter.split(part)]
            else:
                out.append(f"p:{part}")
    return out


def bucket(token: str) -> int:
    return xxhash.xxh64_intdigest(token) % BUCKETS


def lexicon(pages: DataFrame, share: float = WORD_SHARE) -> Segmenter:
    """Words of the pages' visible texts and their log probabilities."""
    plain = F.lower(F.regexp_replace(F.coalesce("html", F.lit("")), "<[^>]*>", " "))
    word = F.explode(F.regexp_extract_all(plain, F.lit(r"[a-z]+"), F.lit(0))).alias("word")
    counts = keep(pages.select(word).where(F.length("word") <= LONGEST_WORD).groupBy("word").agg(F.count(F.lit(1)).alias("n")),
                  "url_words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    # at most 1 / share rows can pass
    rows = counts.where(F.col("n") >= F.lit(share * total)).collect() if total else []
    return Segmenter({r["word"]: math.log(r["n"] / total) for r in rows}, max(total, 1))


def example(host: str, path: str, segmenter: Segmenter, seeds: tuple = SEEDS) -> tuple[int | None, list[str]]:
    """Class and tokens of a training url. The class is its rule's, else blocked
    if its host has a seed word; else it is no example. What the rule names of
    host and path is left out of the tokens."""
    rule = rule_of(host, path)
    if rule is None:
        return (1 if any(s in host for s in seeds) else None), tokens_of(host, path, segmenter)
    named, _, begin = rule[1].partition("/")
    # tokens_of drops the last label, here of the host that the rule names
    return CLASSES.index(rule[0]), tokens_of(host[:len(host) - len(named)] + "rule", path[len(begin) + 1:], segmenter)


@dataclass
class Bayes:
    prior: np.ndarray
    weight: np.ndarray  # class, bucket

    def verdict(self, tokens: list[str]) -> str:
        score = self.prior.copy()
        for t in tokens:
            score += self.weight[:, bucket(t)]
        return CLASSES[int(score[1] > score[0])]


def fit(pages: DataFrame, segmenter) -> Bayes:
    """Counts of urls and tokens per class over all pages; the driver gets at
    most a number per class and bucket."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS + 1), np.int64)  # the last column counts urls
        for batch in batches:
            for url in batch.column("url").to_pylist():
                host, path = split_url(url)
                kind, tokens = example(host, path, segmenter.value)
                if kind is not None:
                    counts[kind, BUCKETS] += 1
                    for t in tokens:
                        counts[kind, bucket(t)] += 1
        kind, place = np.nonzero(counts)
        yield pa.RecordBatch.from_pydict({"kind": pa.array(kind, pa.int32()), "place": pa.array(place, pa.int32()),
                                          "n": pa.array(counts[kind, place], pa.int64())})

    rows = (pages.select("url").mapInArrow(work, "kind int, place int, n long")
            .groupBy("kind", "place").agg(F.sum("n").alias("n")).collect())
    counts = np.zeros((2, BUCKETS + 1))
    for r in rows:
        counts[r["kind"], r["place"]] = r["n"]
    urls, tokens = counts[:, BUCKETS], counts[:, :BUCKETS]
    seen = max(1, int((tokens.sum(axis=0) > 0).sum()))
    weight = np.log((tokens + 1) / (tokens.sum(axis=1, keepdims=True) + seen))
    return Bayes(np.log((urls + 1) / (urls.sum() + 2)), weight)


def judge_urls(pages: DataFrame) -> DataFrame:
    """A row per page: page_id, host, path, rule, verdict."""
    context = pages.sparkSession.sparkContext
    segmenter = context.broadcast(lexicon(pages.select("html")))
    bayes = context.broadcast(fit(pages, segmenter))

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = {"host": [], "path": [], "rule": [], "verdict": []}
        for url in batch.column("url").to_pylist():
            host, path = split_url(url)
            rule = rule_of(host, path)
            verdict = rule[0] if rule else bayes.value.verdict(tokens_of(host, path, segmenter.value))
            for name, value in zip(out, (host, path, rule[1] if rule else None, verdict), strict=True):
                out[name].append(value)
        yield pa.RecordBatch.from_pydict({"page_id": batch.column("page_id").cast(pa.int64()),
                                          **{k: pa.array(v, pa.string()) for k, v in out.items()}})

    return map_arrow(pages.select("page_id", "url"), work, RESULT)


def op7_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return judge_urls(table(spark, folder, "pages"))
