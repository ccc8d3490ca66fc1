"""Queries without SQL, on whole tables, against plain versions that share none of their plans."""

import hashlib
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from silvaspark.llm import queries, quality
from silvaspark.llm.common import documents, labels

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in documents(spark, FOLDER).select("doc_id", "text").collect()}


def test_quality(spark, docs):
    """Means, covariances and densities by their definitions, on all rows."""
    truth = {r.doc_id: r.quality for r in labels(spark, FOLDER).collect() if r.quality in (0, 1)}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in docs}
    x = {i: np.array(quality.statistics(t)) for i, t in docs.items()}
    d = len(quality.STATISTICS)
    groups = [np.array([x[i] for i in docs if truth.get(i) == y and not held[i]]) for y in (0, 1)]
    total = sum(map(len, groups))
    covariances = [np.cov(g.T, bias=True) for g in groups]
    pooled = sum(len(g) / total * c for g, c in zip(groups, covariances, strict=True))
    logs = []
    for g, c in zip(groups, covariances, strict=True):
        lean = max(0.1, d / (d + len(g)))
        c = (1 - lean) * c + lean * np.diag(np.diag(pooled) + 1e-4)
        inverse, mean = np.linalg.inv(c), g.mean(axis=0)
        logs.append({i: np.log(len(g) / total) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * (v - mean) @ inverse @ (v - mean) for i, v in x.items()})
    found = queries.op1_quality(spark, FOLDER).collect()
    assert len(found) == len(docs)
    for r in found:
        p = 1 / (1 + np.exp(np.clip(logs[0][r.doc_id] - logs[1][r.doc_id], -700, 700)))
        assert r.score == pytest.approx(p, abs=1e-6) and r.held_out == held[r.doc_id] and r.predicted == int(r.score >= 0.3)


def test_secrets(spark, docs):
    """Base spans by one plain scan for each pattern; the spans hold them all."""
    patterns = {
        "assign": (r"""(?:password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 1, 6),
        "access": (r"(AKIA[A-Z0-9]+)", 0, 1, 20),
        "hex": (r"([0-9a-f]+)", 0, 1, 24),
    }
    found = {r.doc_id: r for r in queries.op6_secrets(spark, FOLDER).collect()}
    assert found.keys() == docs.keys()
    for i, text in docs.items():
        spans = [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for k, (kind, (p, flags, group, least)) in enumerate(patterns.items()) for m in re.finditer(p, text, flags) if len(m[group]) >= least]
        base = [s[2] for s in sorted(spans)]
        kinds, r = Counter(s.split(":")[0] for s in base), found[i]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(kinds[k] for k in patterns)
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("field")] == base


def test_near_duplicates(spark, docs):
    """Links of all pairs, and the least id over them."""
    sets = {}
    for i, text in docs.items():
        words = re.findall(rb"[^\x20\x09-\x0d]+", text.encode().lower())
        sets[i] = {tuple(words[k : k + 2]) for k in range(max(1, len(words) - 1))} if words else set()
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(docs)
    for a in ids:
        for b in ids:
            if a < b and min(len(sets[a]), len(sets[b])) * 100 >= 80 * max(len(sets[a]), len(sets[b])) and (both := len(sets[a] & sets[b])) and 100 * both >= 80 * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.op7_near_dedup(spark, FOLDER).collect()}
    assert found == {i: (len(sets[i]), find(i), find(i) == i) for i in docs}


def test_pipeline(spark, docs):
    """Every stage keeps what a plain version keeps of the rows that it was given; the last places every id once."""
    import corpus_pipeline
    from silvaspark.llm import near_dedup, secrets, toxicity

    rows = documents(spark, FOLDER)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {(r.doc_id, r.text) for r in rows.collect()}
        after = stage(spark, rows, FOLDER)
        path = corpus_pipeline.shared_dir(spark, "brute")
        after.write.parquet(path)
        kept = {(r.doc_id, r.text) for r in spark.read.parquet(path).collect()}
        if name == "toxicity":
            scored = {r.doc_id for r in toxicity.score(rows, labels(spark, FOLDER)).filter("predicted = 0").collect()}
            assert kept == {r for r in before if r[0] in scored}
        elif name == "exact_dedup":
            least = {}
            for i, t in sorted(before, key=lambda r: r[0]):
                least.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", t or ""), (i, t))
            assert kept == set(least.values())
        elif name == "near_dedup":
            found = near_dedup.near_duplicates(rows, 5, 80).filter("kept").collect()
            assert kept == {r for r in before if r[0] in {f.doc_id for f in found}} and len(kept) < len(before)
        else:
            assert {r[0] for r in kept} == {r[0] for r in before} and not any(secrets.base_spans(t or "") for _, t in kept)
        rows = spark.read.parquet(path)
    packed = corpus_pipeline.STAGES[-1][1](spark, rows, FOLDER).collect()
    placed = Counter()
    for r in packed:
        placed[r.doc_id] += r.length
    assert placed == {r.doc_id: r.doc_tokens for r in packed} and placed.keys() == {r.doc_id for r in rows.collect()}
