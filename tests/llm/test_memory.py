"""What a task kept is gone when the next task of the same worker begins."""

import gc
import random
import re
import tracemalloc
import weakref
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa

from silvaspark.llm.common import Kept, calm, slices


class Holder:
    """Keeps a function of itself, as finders of secrets do."""

    def __init__(self):
        self.kept = Kept(self.lengths, 1000)

    def lengths(self, words):
        return [len(w) for w in words]


def test_a_task_frees_what_the_last_one_kept():
    calm()
    holder = Holder()
    assert holder.kept(["a", "bb"]) == [1, 2]
    seen = weakref.ref(holder)
    del holder
    batch = pa.RecordBatch.from_arrays([pa.array(["x"])], names=["text"])
    assert [b.num_rows for b in slices(iter([batch]))] == [1]
    assert seen() is None


class Captured:
    """Documents whose function of batches is taken instead of run by Spark."""

    schema = None

    def selectExpr(self, *columns):  # noqa: N802
        return self

    def mapInArrow(self, run, schema):  # noqa: N802
        return run


def test_stages_of_the_chain_hold_little_text_at_once(monkeypatch):
    """512 rows or 2 MB, a quarter of what the queries hold; every row comes out, changed as it should be."""
    from silvaspark.llm import secrets, toxicity

    seen = []
    real = secrets.Finder.spans_of
    monkeypatch.setattr(secrets.Finder, "spans_of", lambda self, texts: seen.append((len(texts), sum(map(len, texts)))) or real(self, texts))
    monkeypatch.setattr(toxicity, "fit", lambda docs, labels: toxicity.Model({"idiot": True}, np.array([-3.0, 1, 0.2, 0.5, 0.1, 1, 1, 0, 1])))
    scorer = toxicity.Model.scorer

    def watched(self, keep):
        scores = scorer(self, keep)
        return lambda texts: seen.append((len(texts), sum(map(len, texts)))) or scores(texts)

    monkeypatch.setattr(toxicity.Model, "scorer", watched)
    texts = ["word " * 20 + f"n{i} password = abcdef{i:06}" for i in range(1500)] + ["long words " * 30_000] * 20
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    masked = [t for b in secrets.without_secrets(Captured(), secrets.Field())(iter([batch])) for t in b.column("text").to_pylist()]
    assert masked == [t[: t.index("password")] + "[SECRET]" if "password" in t else t for t in texts]
    assert sum(n for n, _ in seen) == len(texts) and max(n for n, _ in seen) <= 512 and max(size for _, size in seen) <= 2 << 20
    seen.clear()
    kept = [i for b in toxicity.without_toxic(Captured(), None)(iter([batch])) for i in b.column("doc_id").to_pylist()]
    assert kept == list(range(len(texts))) and sum(n for n, _ in seen) == len(texts) and max(n for n, _ in seen) <= 512 and max(size for _, size in seen) <= 2 << 20


def held_mb():
    return int(re.search(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024


def test_packing_in_a_chain_leaves_nothing_behind():
    """Tasks of one worker keep no more memory one after another; their pieces are those of an encoder that keeps all words."""
    from silvaspark.llm import packing

    path, rng = public_tokenizers.path("byte_bpe_50k.json"), random.Random(3)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(4, 9))) for _ in range(60_000)]
    texts = [" ".join(words[k : k + 100]) + ("  and\n\nblanks" if k % 300 == 0 else ".") for k in range(0, len(words), 100)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    pieces = lambda **keep: [r for b in packing.pack(Captured(), path, **keep)(iter([batch])) for r in b.to_pylist()]
    first = pieces(keep=200_000)
    after = held_mb()
    for _ in range(5):
        assert pieces(keep=200_000) == first
    assert held_mb() - after < 30  # an encoder made anew by each task left 15 to 35 MB each time
    assert first == pieces()


def test_secrets_in_a_chain_need_little_memory():
    """The arrays of a slice's tokens take most of it: with 2 MB of text at once these 4 MB took 85 MB, with a quarter 25."""
    from silvaspark.llm import secrets

    run = secrets.without_secrets(Captured(), secrets.Field())
    texts = ["of a no to it is " * 500 + "password = abcdef123456"] * 480
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    tracemalloc.start()
    masked = [t for b in run(iter([batch])) for t in b.column("text").to_pylist()]
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert len(masked) == 480 and all(t.endswith("[SECRET]") for t in masked)
    assert most < 60


def test_toxicity_in_a_chain_keeps_few_places():
    """The places of a word are its costliest entry; only texts with a hit need them."""
    from silvaspark.llm import toxicity

    model = toxicity.Model({"idiot": True}, np.array([-3.0, 1, 0.2, 0.5, 0.1, 1, 1, 0, 1]))
    texts = ["you idiot " + " ".join(f"word{i}x{k}" for k in range(300)) for i in range(100)]
    found, most = [], []
    model.scorer()(texts[:1])
    for keep in (toxicity.MEMO_WORDS, toxicity.STAGE_WORDS):
        gc.collect()
        tracemalloc.start()
        scores = model.scorer(keep)
        found.append([scores([t])[0] for t in texts])
        most.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        del scores
    assert found[0] == found[1] and most[1] < 0.8 * most[0], most
