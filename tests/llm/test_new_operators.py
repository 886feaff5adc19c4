"""Manifest, toxicity and phrases against brute-force versions, on hard little cases."""

import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabweave.llm import merkle, phrases, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string, part int, leaf string"


def frame(spark, rows):
    """Rows with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "x", 7, "y") for r in rows], DOCS)


# Merkle manifest

def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def tree(leaves, fan):
    """Root and the siblings (left, right) of each leaf, level by level."""
    paths, nodes, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = i // fan * fan
            paths[k].append(("".join(nodes[run:i]), "".join(nodes[i + 1:run + fan])))
        nodes = [h(*nodes[i:i + fan]) for i in range(0, len(nodes), fan)]
        at = [i // fan for i in at]
    return nodes[0], paths


def plain_manifest(rows, claimed, fan):
    told = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d, text: h(told(d[0]), told(d[3]), told(d[2]), told(d[4]), told(text))
    groups = {}
    for d in rows:
        groups.setdefault(d[3], []).append((d[0] is not None, d[0] or 0, leaf(d, d[1]), leaf(d, claimed(d)), d[0]))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    made = {s: tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])], fan) for s in order}
    root, tops = tree([made[s][0] for s in order], fan)
    out = []
    for s, top in zip(order, tops, strict=True):
        for x, path in zip(sorted(groups[s], key=lambda x: x[:3]), made[s][1], strict=True):
            node = x[3]
            for left, right in [*path, *top]:
                node = h(left, node, right)
            out.append((x[4], x[2], made[s][0], root, h(*(a + b for a, b in [*path, *top])), node, node == root))
    return out


def order(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("fan,range_leaves", [(16, 1 << 17), (2, 3), (3, 7)])
def test_manifest(spark, monkeypatch, fan, range_leaves):
    monkeypatch.setattr(merkle, "RANGE_LEAVES", range_leaves)
    pick = random.Random(fan)
    rows = [(k, pick.choice(["Ab c", "é" * 900, "", None, "x"]), pick.choice(["en", None]), pick.choice(["hot"] * 6 + ["ä", "b", None, ""]), k)
            for k in range(70)]
    rows += [(None, "n", "en", "hot", None), (5, "again", "en", "hot", 1), (5, "again", "en", "hot", 1), (900, "alone", None, "single", 0)]
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    made = merkle.manifest(frame(spark, rows).repartition(4), {"text": F.translate("text", upper, upper.lower())}, True, fan).collect()
    want = plain_manifest(rows, lambda d: d[1] and d[1].translate(str.maketrans(upper, upper.lower())), fan)
    assert order(tuple(r)[:7] for r in made) == order(want)
    for r in made:  # the proofs themselves
        node, joined = r.leaf, ""
        for s in r.proof:
            node, joined = h(*s.left, node, *s.right), joined + "".join([*s.left, *s.right])
        assert node == r.root and h(joined) == r.proof_sha256
    assert merkle.manifest(frame(spark, rows).limit(0)).count() == 0
    one = merkle.manifest(frame(spark, rows[:1])).first()
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == h("") and one.verified


def test_multiproof():
    """The missing nodes suffice, and none of them can be derived from the others and the run."""
    for fan in (2, 3, 16):
        for size in (1, 2, 5, 17, 50, 257):
            leaves = [h(str(k)).encode() for k in range(size)]
            root, paths = tree([x.decode() for x in leaves], fan)
            levels = merkle.climb(leaves, 0, size, fan)
            for at, count in ((0, 1), (0, size), (size // 2, 1), (size // 3, max(1, size // 3)), (size - 1, 1)):
                need = merkle.missing(at, count, size, fan)
                got, path = merkle.expand(leaves[at:at + count], at, size, {n: levels[n[0]][1][n[1]] for n in need}, fan)
                assert got.decode() == root
                assert [[(a.decode(), b.decode()) for a, b in path(k)] for k in range(count)] == paths[at:at + count]
                held = {(0, p) for p in range(at, at + count)} | set(need)
                for level, p in need:  # its children are never all known
                    assert level == 0 or not all((level - 1, c) in held for c in range(p * fan, min((p + 1) * fan, levels[level - 1][2])))
                owned = {(k, lv[0] + i) for k, lv in enumerate(merkle.climb(leaves[at:at + count], at, size, fan)) for i in range(len(lv[1]))}
                assert not owned & set(need)


# Phrases

def plain_phrases(rows, least, longest, share, first):
    import re

    counts, totals = {}, Counter()
    for d in rows:
        lang, text = d[2] or "und", (d[1] or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        for piece in re.split("[.,;:!?\x0A-\x0D]", text):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in range(1, longest + 1):
                counts.setdefault(lang, Counter()).update(tuple(words[i:i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, f in counts.items():
        found = []
        for c in [c for c, a in f.items() if len(c) > 1 and a >= least]:
            a = f[c]
            score, _, left, right = min((1_000_000 * a * a // (f[c[:k]] * f[c[k:]]), k, f[c[:k]], f[c[k:]]) for k in range(1, len(c)))
            inside = lambda o, c=c: any(o[i:i + len(c)] == c for i in range(len(o) - len(c) + 1))
            if not any(n >= least and 100 * n >= share * a and len(o) > len(c) and inside(o) for o, n in f.items()):
                found.append((-score, -a, " ".join(c).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:first], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("least,longest,sample,bits", [(3, 3, 0.5, 1 << 16), (2, 4, 0.0, 1 << 16), (4, 3, 1.0, 128), (2, 2, 0.1, 64), (2, 4, 0.05, 256), (2, 5, 0.2, 512)])
def test_phrases(spark, least, longest, sample, bits):
    pick = random.Random(least)
    word = lambda: pick.choice(["a", "B", "cé", "d e", "ab", "É", "x" * 300])
    rows = [(k, "".join(word() + pick.choice([" ", " ", "  ", "\t", ", ", ".", "\n"]) for _ in range(pick.randint(0, 40))),
             pick.choice(["en", "en", None, "und", "fr"]), "s", 1) for k in range(60)]
    rows += [(1, "very long " * 4000, "de", "s", 1), (2, None, "en", "s", 1), (3, "", "es", "s", 1), rows[0], rows[0], (None, "a b a b", "en", None, None)]
    found = phrases.frequent_phrases(frame(spark, rows).repartition(3), least, longest, sample, bits=bits)
    made = phrases.collocations(found, longest, first=30).collect()
    assert sorted(tuple(r) for r in made) == plain_phrases(rows, least, longest, 50, 30)


def test_border_of_few_proposals():
    """The first pass counts single words and what proposals allow, nothing else."""
    def sizes(*proposed):
        now = phrases.Proposals(1 << 16, 3)
        for size, key in proposed:
            place = now.places(pa.array([key]))
            now.maps[size][(place >> np.uint64(6)) % np.uint64(len(now.maps[size]))] |= np.uint64(1) << (place & np.uint64(63))
        made = phrases.count_batch(pa.array(["en"]), pa.array(["a b c a b d"]), 3, now, None)
        return sorted(k.split("\t")[1] for r in made for k in r.column("key").to_pylist() if " " in k)

    assert sizes() == sizes((1, "en\ta")) == []
    assert sizes((1, "en\ta"), (1, "en\tb")) == ["a b"]
    words = [(1, f"en\t{w}") for w in "abcd"]
    assert sizes(*words) == ["a b", "b c", "b d", "c a"]
    assert sizes(*words, (2, "en\ta b"), (2, "en\tb c")) == ["a b", "a b c", "b c", "b d", "c a"]


def test_no_phrases(spark):
    assert phrases.collocations(phrases.frequent_phrases(frame(spark, [(1, "a", "en", "s", 1)]).limit(0))).count() == 0
    # products beyond 64 bits
    big = [("en", 1, "a", 5 * 10**12), ("en", 1, "b", 7 * 10**12), ("en", 2, "a b", 4 * 10**12), ("en", 0, "", 10**14)]
    row = phrases.collocations(spark.createDataFrame(big, "lang string, words int, phrase string, n long")).first()
    assert row.score == 1_000_000 * (4 * 10**12)**2 // (35 * 10**24)


def test_only_heavy_parts_are_dealt_out(spark):
    rows = [("en", f"w{k}", 10) for k in range(500)] + [("en", "the", 5000), ("de", "the", 10)]
    short = spark.createDataFrame(rows, "lang string, part string, f long")
    totals = spark.createDataFrame([("en", 90_000), ("de", 10_000)], "lang string, n long")
    heavy = phrases._heavy(short, totals)
    assert [tuple(r) for r in heavy.collect()] == [("en", "the", True)]
    dealt = Counter((r["lang"], r["part"]) for r in phrases._dealt(short, heavy).collect())
    assert dealt.pop(("en", "the")) == phrases.SALTS and set(dealt.values()) == {1} and len(dealt) == 501


# Toxicity

def test_block_max():
    """The index finds the neighbours that all cosines give."""
    pick, terms = np.random.default_rng(1), 30

    def some(rows):
        row, term, tf = [], [], []
        for i in range(rows):
            held = np.unique(np.minimum(pick.zipf(1.5, pick.integers(0, 6)), terms) - 1)
            row, term, tf = row + [i] * len(held), term + held.tolist(), tf + pick.integers(1, 3, len(held)).tolist()
        return np.array(row, np.int64), np.array(term, np.int64), np.array(tf, np.int64)

    idf = 1 + pick.random(terms)

    def dense(vectors, rows):
        out = np.zeros((rows, terms))
        out[vectors.row(), vectors.terms] = vectors.weights
        return out

    for block in (4, 64):
        examples, queries = (toxicity.Vectors.of(n, *some(n), idf) for n in (300, 80))
        index = toxicity.BlockMaxIndex(examples, terms, block)
        cosines = np.round(dense(queries, 80) @ dense(examples, 300).T * toxicity.STEPS).astype(np.int64)
        for k in (1, 5, 15):
            want = set()
            for q in range(80):
                best = np.sort(cosines[q][cosines[q] > 0])[::-1]
                least = best[k - 1] - 1 if len(best) >= k else 1
                want |= {(q, e) for e in np.flatnonzero((cosines[q] > 0) & (cosines[q] >= least)).tolist()}
            own, example, _ = index.nearest(queries, k)
            assert set(zip(own.tolist(), example.tolist(), strict=True)) == want


def test_rising():
    knots, levels = toxicity.rising(np.array([0.0, 0.2, 0.5, 0.7, 1.0]), np.array([0.0, 3, 1, 4, 5]), np.array([5.0, 5, 5, 5, 5]))
    assert knots.tolist() == [0.0, 0.2, 0.7, 1.0] and levels.tolist() == [0.0, 0.4, 0.8, 1.0]


def test_toxicity(spark):
    pick = random.Random(2)
    bad = ["scum", "vermin", "trash"]
    rows, truth = [], {}
    for k in range(1200):
        words = [f"w{int(pick.paretovariate(0.7)) % 500}" for _ in range(pick.randint(5, 80))]
        truth[k] = int(pick.random() < 0.2)
        if truth[k]:
            for _ in range(pick.randint(1, 3)):
                words.insert(pick.randrange(len(words)), pick.choice(bad).title())
        rows.append((k, " ".join(words), pick.choice(["en", None]), "s", 1))
    rows += [(5000, None, "en", "s", 1), (5001, "", "en", "s", 1), (5002, "scum " * 50_000, "en", "s", 1), (5003, "kind words", "en", "s", 1), rows[7], rows[7],
             (None, "vermin!", None, None, None)]
    labels = [(k, t) for k, t in truth.items() if k % 3] + [(7, 1 - truth[7]), (8, None), (None, 1), (99999, 1)]
    docs = frame(spark, rows)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    made = toxicity.score_texts(docs.repartition(3), model).collect()
    assert len(made) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in made)
    held = [r for r in made if r.doc_id is not None and r.doc_id < 1200 and r.doc_id % 3 == 0]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.99 * len(held)
    scores = {r.doc_id: r for r in made}
    assert scores[5000].score == scores[5001].score == scores[5003].score < 0.2 and scores[5000].neighbours == []
    assert scores[5002].predicted == 1 and scores[None].predicted == 1
    assert all(n.toxic > 0.5 for n in scores[5002].neighbours) and len(scores[5002].neighbours) > 0
    # calibrated: about as many are toxic as the scores say
    assert abs(sum(r.score for r in held) - sum(truth[r.doc_id] for r in held)) < 0.1 * len(held)
    assert toxicity.score_texts(docs.limit(0), model).count() == 0
    bare = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.score_texts(docs, bare).collect()} == {0.0}


def test_term_batch():
    row, term, tf = toxicity.term_batch(pa.array(["B a! b", None, "", "a-a c"]), pa.array([b"a", b"b"], pa.large_binary()))
    assert list(zip(row.tolist(), term.tolist(), tf.tolist(), strict=True)) == [(0, 0, 1), (0, 1, 2), (3, 0, 2)]
