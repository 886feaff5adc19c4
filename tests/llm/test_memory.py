"""What a worker process holds while it works, and keeps between tasks."""

import gc
import random
import tracemalloc

import numpy as np
import pyarrow as pa

from tabweave.llm import quality, tokens


def test_counts_of_a_batch_are_made_in_small_parts():
    """A batch of 12 MB takes arrays for a part of it, not many times its bytes."""
    pick = random.Random(3)
    words = [f"w{pick.randrange(50_000)}" for _ in range(2000)]
    texts = pa.array([" ".join(words[k % 7:]) for k in range(1000)])
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(1000)), "text": texts})
    work = quality.count_parts(["doc_id", "text"])
    tracemalloc.start()
    made = [part.column(quality.FOUND).field("n_words").to_numpy() for part in work(batch)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.concatenate(made).tolist() == [2000 - k % 7 for k in range(1000)]
    assert texts.nbytes > 12e6 and peak < 80e6


def test_piece_memory_is_small():
    """Pieces that a worker remembers take tens of bytes each."""
    encoder, count = tokens.Encoder(tokens.read_tokenizer()), 60_000
    encoder.encode(pa.array(["a"]))
    gc.collect()
    before = pa.total_allocated_bytes()
    tracemalloc.start()
    ids, cuts = encoder.encode(pa.array([" ".join(f"p{k}" for k in range(count))]))
    del ids, cuts
    gc.collect()
    held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before
    tracemalloc.stop()
    assert len(encoder.known) + len(encoder.older) >= count and held < 60 * count


def test_remembered_pieces_give_the_same_ids(monkeypatch):
    """New, known and older pieces, in texts of every mix, across many turns of the halves."""
    monkeypatch.setattr(tokens, "REMEMBERED", 30)
    encoder, pick = tokens.Encoder(tokens.read_tokenizer()), random.Random(5)
    turns = 0
    for _ in range(60):
        texts = [" ".join(f"wörd{int(pick.expovariate(0.05))}" for _ in range(pick.randrange(12))) for _ in range(4)] + ["", None]
        ids, cuts = encoder.encode(pa.array(texts, pa.string()))
        turns += len(encoder.known) == 0
        for k, text in enumerate(texts):
            assert ids[cuts[k]:cuts[k + 1]].tolist() == [*encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, tokens.END]
    assert turns > 3
    assert encoder.encode(pa.array([], pa.string()))[1].tolist() == [0]
    assert encoder.encode(pa.array([None, ""], pa.string()))[0].tolist() == [tokens.END] * 2
