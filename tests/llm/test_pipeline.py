"""The pipeline against a plain version of its stages."""

import brute

import corpus_pipeline
from tabweave.llm import mixing, tokens


def test_pipeline(spark, folder):
    import public_tokenizers

    table = spark.read.parquet(f"{folder}/documents.parquet")
    docs = {r.doc_id: r for r in table.collect()}
    counts = {d: brute.quality_counts(r.text) for d, r in docs.items()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    passed = corpus_pipeline.quality_rules(spark, table, folder)
    assert passed.columns == table.columns
    kept = {r.doc_id for r in passed.collect()}
    assert all(counts[d][0] >= 50 and counts[d][4] * 2 <= counts[d][0] for d in kept)
    assert all(d in kept for d, good in labels.items() if good and counts[d][0] >= 50 and counts[d][4] * 2 <= counts[d][0])
    near = brute.near_dups([(d, docs[d].text) for d in kept])
    kept = {d for d in kept if near[d][1] == d}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    kept = {r[0] for r in brute.leaks([(d, docs[d].text) for d in kept], items, 10) if not r[5]}
    left = spark.createDataFrame([docs[d] for d in sorted(kept)], table.schema)
    copies = {r.doc_id: r._mix_copies for r in mixing.mix(left).collect()}
    want, at = [], 0
    path = public_tokenizers.path(tokens.TOKENIZER)
    for d in sorted(kept):
        row = brute.token_rows([(d, docs[d].text)], path)[0]
        for _ in range(copies[d]):
            want.append((d, at, *row[2:]))
            at += row[2]
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, folder).collect()) == want
