"""Every operator against its brute-force version, on the given tables and on hard little cases."""

import itertools
import random
import time

import brute
import numpy as np
import pyarrow as pa
import pytest
from oracle import connect, difference
from pyspark.sql import functions as F

from tabweave.llm import automaton, contamination, huffman, lines, mixing, neardup, personal, quality, registry, secrets
from tabweave.llm import semicrf, substrings, tokens, urls
from tabweave.llm import words as W

LONG = " ".join(f"w{k % 977}x{k % 13}" for k in range(30_000))
HARD = [(1, None), (2, ""), (3, "a b c a b c a b c a b"), (4, "x a b c"), (5, "a b c y"), (6, "x a b c"), (7, "\n\t \r"),
        (8, LONG), (9, LONG + " tail"), (10, "é ü " * 40)]


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def small(spark, rows):
    """Rows with further columns whose names the operators use themselves."""
    made = [(d, t, "en", None if d == 3 else "s", 1, "x", True) for d, t in rows]
    return spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_words int, rep string, kept boolean")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql(spark, folder, name):
    assert difference(registry.QUERIES[name](spark, folder), connect(folder), registry.ORACLES[name]) is None


def test_substrings(spark, folder, rows):
    got = {r[0]: tuple(r)[1:4] for r in registry.QUERIES["op1_substring_dedup"](spark, folder).collect()}
    assert got == brute.substring_dedup(rows, 20)


@pytest.mark.parametrize("length,chunk_bytes,buckets", [(3, 10, 1), (3, 1 << 20, 7), (4, 60, 3), (1, 50, 2)])
def test_substrings_hard(spark, length, chunk_bytes, buckets):
    made = substrings.substring_dedup(small(spark, HARD).repartition(3), length, True, chunk_bytes, buckets).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in made} == brute.substring_dedup(HARD, length)
    assert all(sum(x.stop - x.start for x in r.repeats) == r.n_removed and brute.sha(r.kept_text) == r.kept_sha256 for r in made)


def test_leaks(spark, folder, rows):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    got = sorted(tuple(r)[:6] for r in registry.QUERIES["op2_decontaminate"](spark, folder).collect())
    assert got == sorted(brute.leaks(rows, items, 10))


@pytest.mark.parametrize("block_words", [1_000_000, 3])
def test_leaks_hard(spark, block_words):
    rows = [*HARD, (11, "A b-C y"), (11, "A b-C y"), (None, "c a b z")]
    items = [(1, "a b c"), (2, "b c a b"), (3, "X"), (None, "y"), (4, None), (5, ""), (1, "q r s t")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = contamination.find_leaks(small(spark, rows), bench, length=3, block_words=block_words)
    s = F.col(contamination.FOUND)
    got = found.select("doc_id", s["n_words"], s["n_hit"], F.size(s["items"]), F.sha2(F.concat_ws(",", s["items"]), 256), s["n_hit"] > 0)
    order = lambda x: str(x)
    assert sorted(map(tuple, got.collect()), key=order) == sorted(brute.leaks(rows, items, 3), key=order)
    clean = contamination.decontaminate(small(spark, rows), bench, length=3)
    assert clean.columns == small(spark, rows).columns
    longest = contamination.longest_matches(small(spark, rows), bench, length=3).where("doc_id = 3 AND item_id = '2'")
    assert longest.agg(F.max("length")).first()[0] == 4


def test_near_dups(spark, folder, rows):
    got = {r[0]: tuple(r)[1:3] for r in registry.QUERIES["op3_near_dedup"](spark, folder).collect()}
    assert got == brute.near_dups(rows)


def test_near_dups_hard(spark):
    """Chains of edits whose ends are no links, copies, and texts between which a leader is no bridge."""
    pick, base = random.Random(4), [f"t{k}" for k in range(120)]
    rows, text = [], list(base)
    for k in range(60):
        rows.append((k, " ".join(text)))
        if k % 3:
            text[pick.randrange(120)] = f"n{k}"
    rows += [(100 + k, " ".join(base[:2 * k])) for k in range(40)] + [(200, None), (201, ""), (202, "one two"), (203, "ONE two")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.components(small(spark, rows)).collect()}
    assert got == brute.near_dups(rows)
    odd = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")
    assert sorted(map(str, (r.component_id for r in neardup.components(odd).collect()))) == ["1", "1", "None"]


def test_superminhash_estimates():
    pick = np.random.default_rng(1)
    items = pick.integers(0, 2**63, 3000).astype(np.uint64)
    for size in (1, 5, 60, 1000):
        a, b = items[:size], items[size // 4:size + size // 4]
        sig = neardup.superminhash(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]), 125)
        assert (sig >> np.uint64(32)).max() < 125
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((sig[0] == sig[1]).mean() - true) < 0.2
        if size == 1:  # the ranks of one element are a permutation
            assert sorted((sig[0] >> np.uint64(32)).tolist()) == list(range(125))


def test_quality(spark, folder, rows):
    made = registry.QUERIES["op4_quality_rules"](spark, folder).collect()
    want = {d: brute.quality_counts(t) for d, t in rows}
    assert all(tuple(r)[1:6] == want[r.doc_id] for r in made)
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in made)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    judged = [(r.kept, labels[r.doc_id]) for r in made if r.doc_id in labels and not r.base_failed]
    assert all(kept == bool(good) for kept, good in judged)


def test_quality_hard(spark):
    made = {r.doc_id: tuple(r)[1:] for r in quality.with_counts(small(spark, HARD), drop_text=True)
            .select("doc_id", *(f"{quality.FOUND}.{s}" for s in quality.STATS)).collect()}
    assert made == {d: brute.quality_counts(t) for d, t in HARD}
    assert quality.good_documents(small(spark, HARD[:7])).count() == 0


def test_least_scatter():
    pick = np.random.default_rng(0)
    bulk, off = pick.normal(0, 1, (300, 2)), pick.normal(8, 0.5, (60, 2))
    cells, weight = np.unique(np.round(np.vstack([bulk, off]), 1), axis=0, return_counts=True)
    inner = np.zeros((len(cells), 2, 2))
    centre, scatter = quality.cover_least_scatter(cells, inner, weight.astype(float), np.array([0.1, 0.1]))
    assert np.abs(centre).max() < 0.3 and np.abs(scatter).max() < 2
    # against the best of all subsets
    few = np.array([[0.0, 0], [1, 0.2], [0.3, 1], [0.8, 0.9], [0.4, 0.1], [0.6, 0.5], [9, 9], [9, 8]])
    centre, _ = quality.cover_least_scatter(few, np.zeros((8, 2, 2)), np.ones(8), np.array([1e-6, 1e-6]))
    best = min(itertools.combinations(range(8), 6), key=lambda c: np.linalg.det(np.cov(few[list(c)].T)))
    assert np.allclose(centre, few[list(best)].mean(axis=0))
    assert abs(quality.chi_square_cut(4, 0.05) - 9.4877) < 1e-3


def test_quality_distances(spark, folder):
    """Centres are those of the documents, so the middle one lies about where that of a normal
    vector does (3.36); the grid is coarse for 200 documents, hence a factor of two."""
    made = registry.QUERIES["op4_quality_rules"](spark, folder).where("NOT base_failed")
    plain = made.select((F.col("distance") * (F.col("n_words") + quality.TYPICAL_WORDS) / (2 * F.col("n_words"))).alias("plain"))
    assert 3.36 / 2 < plain.approxQuantile("plain", [0.5], 0.001)[0] < 3.36 * 2
    docs = spark.createDataFrame([(k, "en", "s", " ".join(f"{'x' * (3 + (k + j) % 4)}{k}{j}" for j in range(60))) for k in range(60)],
                                 "doc_id long, lang string, source string, text string")
    counted = quality.with_counts(docs, drop_text=True)
    groups, _ = quality.estimates(counted)
    lengths = [r[0] for r in counted.select(f"{quality.FOUND}.word_chars").collect()]
    centre = groups.first()["centre"]
    assert min(lengths) / 60 <= centre[0] <= max(lengths) / 60 and centre[1:] == [0.0, 0.0, 0.0]


def test_tokens(spark, folder, rows):
    import public_tokenizers

    got = sorted(tuple(r) for r in registry.QUERIES["op5_token_binary"](spark, folder).collect())
    assert got == brute.token_rows(rows, public_tokenizers.path(tokens.TOKENIZER))


def thue_morse(length=1024):
    """Two words that any polynomial hash modulo 2**64 takes for one, and their mirror."""
    word = "a"
    while len(word) < length:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_no_cancelling(spark):
    one, two = thue_morse()
    tail = " ".join(f"t{k}" for k in range(25))
    rows = [(1, f"{one} {tail}"), (2, f"{two} q {tail[:40]}"), (3, one), (4, two), (5, f"{one}\n{two}\n{one}")]
    frame = small(spark, rows)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.substring_dedup(frame, 1).collect()}
    assert got == brute.substring_dedup(rows, 1)
    items = [(1, one), (2, "zz")]
    found = contamination.find_leaks(frame, spark.createDataFrame(items, "item_id long, text string"), length=3)
    s = F.col(contamination.FOUND)
    assert {r[0]: r[1] for r in found.select("doc_id", s["n_hit"]).collect()} == {r[0]: r[2] for r in brute.leaks(rows, items, 3)}
    near = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.components(frame).select("doc_id", "n_shingles", "component_id").collect()}
    assert near == {d: tuple(v[:2]) for d, v in brute.near_dups(rows).items()}
    made = {r[0]: r[1] for r in quality.with_counts(frame).select("doc_id", f"{quality.FOUND}.n_dup_lines").collect()}
    assert made == {d: brute.quality_counts(t)[3] for d, t in rows}
    encoder = tokens.Encoder(tokens.read_tokenizer())
    ids, cuts = encoder.encode(pa.array([t for _, t in rows]))
    assert [ids[a:b - 1].tolist() for a, b in zip(cuts, cuts[1:], strict=False)] == [encoder.tokenizer.encode(t).ids for _, t in rows]
    codes, distinct = W.codes(W.span_texts(np.frombuffer(b"ab ab  c", np.uint8), np.array([0, 3, 6, 7]), np.array([2, 5, 6, 8])))
    assert codes.tolist() == [0, 0, 1, 2] and distinct.to_pylist() == [b"ab", b"", b"c"]


def test_added_tokens():
    encoder, pick = tokens.Encoder(tokens.read_tokenizer()), random.Random(4)
    parts = [" ", "  ", "\n", "a", "B", "<|endoftext|>", "<|endof", "text|>", "<|", "|>", "é", ".", "x y"]
    texts = ["a <|endoftext|> b", "<|endof", "text|>", *("".join(pick.choice(parts) for _ in range(12)) for _ in range(400))]
    ids, cuts = encoder.encode(pa.array(texts))
    for k, text in enumerate(texts):
        assert ids[cuts[k]:cuts[k + 1] - 1].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_secrets_grow_in_line():
    """Twice the text takes about twice the time, however many rows match."""
    compiled = secrets.machines()
    def seconds(rows):
        begin = time.perf_counter()
        secrets.scan_texts(pa.array(["0123456789abcdef" * 25] * rows), compiled)
        return time.perf_counter() - begin
    seconds(100)
    assert seconds(8000) < 8 * seconds(2000)


def test_tokens_hard(spark):
    """Cutting texts into pieces changes no id, whatever the white space."""
    encoder, pick = tokens.Encoder(tokens.read_tokenizer()), random.Random(3)
    parts = [" ", "  ", "\n", "\n\n", "\t", "a", "the", "é", "\u00a0", "\u2003", "don't", "'s", "12", " 3", "!", "?! ", "\u201c", "\x1c", "\u0085", "."]
    texts = [None, "", *("".join(pick.choice(parts) for _ in range(20)) for _ in range(500))]
    ids, cuts = encoder.encode(pa.array(texts, pa.string()))
    for k, text in enumerate(texts):
        want = encoder.tokenizer.encode(text or "", add_special_tokens=False).ids + [tokens.END]
        assert ids[cuts[k]:cuts[k + 1]].tolist() == want
    made = sorted(tuple(r) for r in tokens.encode_and_read(small(spark, HARD)).collect())
    import public_tokenizers

    assert made == brute.token_rows(HARD, public_tokenizers.path(tokens.TOKENIZER))
    assert tokens.encode_and_read(small(spark, HARD).limit(0)).count() == 0


@pytest.mark.parametrize("counts,limit", [([7], 18), ([5, 0, 1, 1, 9, 100], 3), (list(2**np.arange(30)), 8), ([1] * 257, 12)])
def test_huffman(counts, limit):
    lengths = huffman.code_lengths(np.array(counts), limit)
    used = lengths[lengths > 0].astype(float)
    assert lengths.max() <= limit and (2.0**-used).sum() <= 1
    ids = np.random.default_rng(2).choice(np.flatnonzero(counts), 2000)
    code = huffman.Code(lengths)
    data, checkpoints = code.encode(ids)
    assert (code.decode(data, checkpoints, len(ids)) == ids).all()


def test_mixing_hard(spark):
    made = mixing.mix(small(spark, HARD)).collect()
    assert {r._mix_size for r in made if r.doc_id in (1, 2, 7)} == {0}
    assert sum(r._mix_copies * r._mix_size for r in made) <= 2 * sum(r._mix_size for r in made)
    assert mixing.mixed_documents(small(spark, HARD)).columns == small(spark, HARD).columns
    assert mixing.mix(small(spark, HARD).limit(0)).count() == 0
    nameless = spark.createDataFrame([(None, f"word {k}", "t") for k in range(300)] + [(1, "a b " * 600, "s")], "doc_id long, text string, source string")
    copies = [r._mix_copies for r in mixing.mix(nameless).where("doc_id is null").collect()]
    assert abs(sum(copies) / 300 - 1.125) < 0.08 and set(copies) == {1, 2}  # rows without doc_id are not decided as one


def test_clashing_columns(spark, folder):
    """Columns with names that the stages add come back as they were."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    for name, stage in (("_QUALITY", quality.good_documents), ("_kept", quality.good_documents), ("_mix_size", mixing.mixed_documents),
                        ("_leak_found", lambda d: contamination.decontaminate(d, bench))):
        plain, made = stage(docs), stage(docs.withColumn(name, docs["doc_id"] + 1))
        assert made.columns == [*docs.columns, name] and made.where(f"{name} <> doc_id + 1").count() == 0
        assert made.count() == plain.count()
    assert "_mix_size" in mixing.mix(docs.withColumn("_mix_size", docs["text"]).withColumn("_mix_source", docs["text"])).columns


def test_urls(spark, folder):
    made = registry.QUERIES["op7_url_filter"](spark, folder).collect()
    assert len(made) == spark.read.parquet(f"{folder}/pages.parquet").count()
    assert all(r.verdict == ("block" if r.rule in ("example.com/en/", "net/es/", "net/fr/") else "allow") for r in made if r.rule)
    for url, want in [("http://A.Com/x?y", ("a.com", "/x")), ("ftp://a.com#b", ("a.com", "")), (None, ("", "")), ("a.com/x", ("", "")),
                      ("x://?a/b", ("", ""))]:
        assert urls.split_url(url) == want
    assert urls.rule_of("www.example.com", "/en/1") == ("allow", "www.example.com/en/")
    assert urls.rule_of("m.example.com", "/en/1") == ("block", "example.com/en/")
    assert urls.rule_of("xexample.com", "/en/1") == ("allow", "com/") and urls.rule_of("a.net", "/es") is None


def test_url_verdicts(spark, folder):
    """Verdicts without a rule are those of a naive Bayes counted by hand."""
    import math
    from collections import Counter

    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html")
    extra = [(-1, "http://x.org/en/a", None), (-2, "http://cheapcasino.org/play", ""), (-3, None, None), (-4, "http://" + "ab" * 3000 + ".org/", None)]
    pages = pages.unionByName(spark.createDataFrame(extra, pages.schema))
    segmenter = urls.lexicon(pages)
    held = [urls.example(*urls.split_url(r.url), segmenter) for r in pages.select("url").collect()]
    counts = [Counter(t for kind, tokens in held if kind == k for t in tokens) for k in (0, 1)]
    prior = [(sum(kind == k for kind, _ in held) + 1) / (sum(kind is not None for kind, _ in held) + 2) for k in (0, 1)]
    seen = len(set(counts[0]) | set(counts[1]))
    for r in urls.judge_urls(pages).collect():
        if r.rule is None:
            tokens = urls.tokens_of(r.host, r.path, segmenter)
            score = [math.log(prior[k]) + sum(math.log((counts[k][t] + 1) / (counts[k].total() + seen)) for t in tokens) for k in (0, 1)]
            assert r.verdict == urls.CLASSES[int(score[1] > score[0])] or abs(score[0] - score[1]) < 1e-9


def test_url_examples():
    """What a rule names of host and path is no token of its examples."""
    segmenter = urls.Segmenter({"shop": -1.0, "example": -1.0}, 1000.0)
    assert urls.example("shop.example.com", "/en/buy/1", segmenter) == (1, ["h:shop", "p:buy", "p:#"])
    assert urls.example("example.com", "/en/", segmenter) == (1, [])
    assert urls.example("example.com", "/fr/x", segmenter) == (0, ["h:example", "p:fr", "p:x"])
    assert urls.example("xporn.org", "/", segmenter)[0] == 1 and urls.example("a.org", "/en/", segmenter)[0] is None


def test_segmenter():
    import math

    lexicon = {"the": 0.4, "that": 0.3, "hat": 0.2, "cheap": 0.05, "pills": 0.05}
    segmenter = urls.Segmenter({w: math.log(p) for w, p in lexicon.items()}, 1000.0)
    assert segmenter.split("cheappills") == ["cheap", "pills"] and segmenter.split("thehat") == ["the", "hat"]
    assert "".join(segmenter.split("qqthatzz")) == "qqthatzz" and segmenter.split("") == []


def test_secrets(spark, folder, rows):
    for r in registry.QUERIES["op8_secret_scan"](spark, folder).collect():
        want = brute.secrets(dict(rows)[r.doc_id])
        assert r.base_sha256 == brute.sha(",".join(f"{k}:{a}:{b}" for a, k, b in want))
        assert r.n_assign == sum(k == "assign" for _, k, _ in want)


def test_secrets_hard():
    pick, compiled = random.Random(5), secrets.machines()
    parts = ["password", "PassWd", "secret", "token", "api_key", "=", ":", " ", '"', "'", "AKIA", "A", "Z9", "0", "f0", "deadbeef", "é", "\n",
             "abcdef", "0123456789abcdef", "_", ".", "x"]
    texts = [None, "", "f" * 50_000, *("".join(pick.choice(parts) for _ in range(pick.randint(1, 40))) for _ in range(1500))]
    for text, spans in zip(texts, secrets.scan_texts(pa.array(texts, pa.string()), compiled), strict=True):
        assert [s for s in spans if s[1] in secrets.BASE] == brute.secrets(text)
    more = secrets.scan_texts(pa.array(["ghp_" + "Gz" * 20 + " -----BEGIN RSA PRIVATE KEY-----"]), compiled)[0]
    assert [s[1] for s in more] == ["github", "private_key"]
    data = np.frombuffer(("x password: abc " * 500).encode(), np.uint8)
    assert (automaton.scan(compiled[0], data, 1) == automaton.scan(compiled[0], data, 97)).all()


def test_lines_hard(spark):
    rows = [(1, "a\nb\n\nc"), (2, "x\na\nb\nc"), (2, "x\na\nb\nc"), (None, "b\nc"), (4, None), (5, ""), (6, "a\na\na\na"), (7, "\n \n")]
    got = sorted((str(r.doc_id), r.n_lines, r.n_removed, r.kept_text) for r in lines.line_dedup(small(spark, rows)).collect())
    assert got == [("1", 3, 0, "a\nb\nc"), ("2", 4, 3, "x"), ("2", 4, 3, "x"), ("4", 0, 0, ""), ("5", 0, 0, ""), ("6", 4, 3, "a"),
                   ("7", 0, 0, ""), ("None", 2, 2, "")]
    plan = lines.line_dedup(small(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_personal(spark, folder, rows):
    for r in registry.QUERIES["op10_personal_data"](spark, folder).collect():
        want = brute.personal(dict(rows)[r.doc_id])
        assert r.base_sha256 == brute.sha(",".join(f"{k}:{a}:{b}" for a, k, b in want))
        assert {f"{k}:{a}:{b}" for a, k, b in want} <= set(r.spans.split(",")) | {""}


def test_personal_hard():
    pick = random.Random(5)
    parts = ["a", "b.", "@", "+1", " ", "-", ".", "12", "4111 1111 1111 1111", "1.2.3.4", "x@y.z", "(743)", "555", "é", "0", "999", "+"]
    for _ in range(3000):
        text = "".join(pick.choice(parts) for _ in range(pick.randint(1, 14)))
        assert personal.base_spans(text) == brute.personal(text)
    assert personal.base_spans("a" * 200_000 + "1" * 200_000) == []


def test_stretches():
    """Stretches hold every mark, begin and end at white space and do not meet."""
    pick = random.Random(7)
    parts = ["1234", "@", "(at)", " ", "\n", "word", "x" * 60, " a b c d e f g h i j k l m n o p q r s t u v w x y z ", "é", "+"]
    for _ in range(500):
        text = "".join(pick.choice(parts) for _ in range(pick.randint(1, 60)))
        found, last = personal.stretches(text), 0
        for a, b in found:
            assert last <= a < b and (a == 0 or text[a - 1].isspace() or a == last) and (b == len(text) or text[b].isspace())
            last = b
        for m in personal.MARK.finditer(text):
            assert any(a <= m.start() and m.end() <= b for a, b in found)


def test_personal_added(spark):
    """Entities that no pattern finds: in texts without a digit, and late in a long run of numbers."""
    make = lambda k: f"then ask {'abcdefgh'[k % 8]}{k}@mail{k % 7}.example.com or +1 ({k % 900 + 100}) 555-{k % 9000 + 1000} now"
    learnt = [(k, make(k * 37 % 9999)) for k in range(60)]
    runs = " ".join(str(k) for k in range(100, 400))
    asked = [(100, "write to jane(at)mail.example.org today"), (101, f"{runs} or write to jane(at)mail.example.org today"),
             (102, "no data in this one, only words (at) all times"), (103, None), (104, "1234 " * 2_000)]
    got = {r.doc_id: r.spans for r in personal.find_personal(small(spark, learnt + asked)).collect()}
    assert got[100] == "email:9:33"
    at = len(runs) + len(" or write to ")
    assert f"email:{at}:{at + 24}" in got[101].split(",") and got[103] == ""
    assert "email" not in got[102]


def test_random_field():
    """The partition sum over segments is that of all segmentations; held-out spans are found."""
    stretch = semicrf.stretch_of("a 1234 56@b")
    crf = semicrf.SemiCrf(np.random.default_rng(0).normal(0, 0.3, (len(semicrf.KINDS), semicrf.FEATURES)))
    scores = crf.scores(stretch)

    def sums(at):
        if at == len(stretch.ends):
            return 1.0
        return sums(at + 1) + sum(np.exp(scores[k]).sum() * sums(j) for k, (i, j, _) in enumerate(stretch.spans) if i == at)

    assert abs(-crf.gradient(stretch, set())[0] - np.log(sums(0))) < 1e-9
    for text in ("a 1234 56@b", "call +1 (555) 555-1234 or a(at)b.c, 1.2.3.4444 é", ""):
        part = semicrf.stretch_of(text)
        want = [(part.starts[i], part.ends[j - 1], kind) for i, j, kind in crf.best(part)]
        assert crf.best_spans(text) == want
    pick = random.Random(1)
    make = lambda k: f"then ask {'abcdefgh'[k % 8]}{k}@mail{k % 7}.example.com or +1 ({k % 900 + 100}) 555-{k % 9000 + 1000} now"
    trained = semicrf.SemiCrf().train([e for k in range(40) for e in personal.examples(make(pick.randrange(9999)))])
    found = [personal.entities(make(k).replace("@", "(at)"), trained, []) for k in range(5000, 5020)]
    assert sum(any(kind == "email" for _, kind, _ in f) for f in found) >= 18


def test_words():
    data, offsets = W.text_buffer(pa.array(["a  bc", None, "", "é\tx"]))
    words = W.Words(data, offsets)
    assert words.counts.tolist() == [2, 0, 0, 2]
    assert len(set(words.hashes().tolist())) == 4
    items = np.arange(50, dtype=np.uint64)
    assert len(W.sequence_hashes(items, 7)) == 44 and len(W.sequence_hashes(items, 51)) == 0
    assert (W.sequence_hashes(items[3:], 7) == W.sequence_hashes(items, 7)[3:]).all()


def test_empty_tables(spark):
    empty = small(spark, HARD).limit(0)
    assert substrings.substring_dedup(empty).count() == 0 and neardup.components(empty).count() == 0
    assert contamination.find_leaks(empty, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert quality.good_documents(empty).count() == 0 and lines.line_dedup(empty).count() == 0
    assert secrets.find_secrets(empty).count() == 0 and personal.find_personal(empty).count() == 0
    assert urls.judge_urls(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
