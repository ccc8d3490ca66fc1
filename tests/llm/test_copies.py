"""Exact and near copies and fingerprints against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from silvaspark.llm import exact_dedup, fingerprints, near_dedup
from silvaspark.llm.common import range_bucket

SCHEMA = "doc_id long, text string, kept boolean, sig string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, False, "x") for i, t in rows], SCHEMA).repartition(3)


def prose(rng, n, vocabulary=2000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Groups of exact, near and not quite near copies; a chain; short, empty and repeated texts."""
    rng, rows = random.Random(1), []
    for g in range(12):
        words = prose(rng, rng.randint(8, 300)).split()
        for share in (0, 0, 0.01, 0.03, 0.05, 0.08, 0.1, 0.15):
            rows.append(" ".join(w if rng.random() >= share else f"v{rng.randrange(99)}" for w in words))
        rows.append("  " + " ".join(words).upper().replace(" ", "\n") + " ")
    chain = prose(rng, 200).split()
    for k in range(10):
        rows.append(" ".join(chain[8 * k : 8 * k + 120]))
    rows += ["", None, "   ", "one", "One", "one two", "one  two", "a b c d e", "a b c d f", "É é", "é é", "x " * 9000, "x " * 9001] + [prose(rng, 40) for _ in range(30)]
    ids = rng.sample(range(10_000), len(rows))
    return list(zip(ids, rows, strict=True))


def brute_near(rows, words, percent):
    sets = []
    for _, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower())
        sets.append({tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                p, q = sorted((find(a), find(b)), key=lambda k: rows[k][0])
                root[q] = p
    return sorted((rows[k][0], len(sets[k]), rows[find(k)][0], find(k) == k) for k in range(len(rows)))


@pytest.mark.parametrize("words", [2, 5])
def test_near_copies(spark, corpus, words):
    assert sorted(tuple(r) for r in near_dedup.near_duplicates(frame(spark, corpus), words).collect()) == brute_near(corpus, words, 80)


def test_near_copies_in_blocks(spark, monkeypatch):
    """A group in which few pairs are near, beyond one block, with no round of hubs at all."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    monkeypatch.setattr(near_dedup, "HUB_ROUNDS", 1)
    rng = random.Random(2)
    base = prose(rng, 150).split()
    rows = [(k, " ".join(w if rng.random() > 0.06 else f"v{rng.randrange(10**6)}" for w in base)) for k in range(60)]
    assert sorted(tuple(r) for r in near_dedup.near_duplicates(frame(spark, rows), 2).collect()) == brute_near(rows, 2, 80)


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b c"), (4, "a b c"), (4, "a b c"), (6, "a b c"), (None, "")]
    found = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in near_dedup.near_duplicates(frame(spark, rows), 2).collect())
    assert found == [("4", "4", True), ("4", "4", True), ("6", "4", False), ("None", "None", True), ("None", "None", True)]
    assert near_dedup.near_duplicates(frame(spark, rows).filter("false"), 2).count() == 0


def test_estimates(spark):
    rng = np.random.default_rng(3)
    for size, like in ((2000, 0.8), (2000, 0.3), (5000, 0.5)):
        a = rng.integers(0, 2**63, size, dtype=np.uint64)
        same = int(2 * size * like / (1 + like))
        b = np.concatenate([a[:same], rng.integers(0, 2**63, size - same, dtype=np.uint64)])
        regs = near_dedup.sketches([np.unique(a), np.unique(b)])
        assert abs(near_dedup.estimate(regs[0], regs[1]) - like) < 0.12
    far = near_dedup.sketches([np.unique(rng.integers(0, 2**63, 900, dtype=np.uint64)) for _ in range(60)])
    by_chance = np.mean([(far[i] == far[j]).mean() for i in range(60) for j in range(i)])
    assert 0.2 < by_chance / near_dedup.chance() < 5


def test_near_stage_keeps_columns(spark, corpus):
    docs = frame(spark, corpus)
    kept = near_dedup.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in brute_near(corpus, 5, 80) if r[3]}


def brute_exact(rows):
    groups = {}
    norm = lambda t: re.sub(r"[\x20\x09-\x0d]+", " ", t or "")
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    out = []
    for i, t in rows:
        ids = groups[norm(t)]
        keep = min((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_copies(spark, corpus):
    long = "y" * 300
    rows = [*corpus, (None, "one"), (20_000, "a\tb"), (20_001, "a b"), (20_002, "a\n\n b"), (20_002, "a b"), (20_003, long + "1"), (20_004, long + "2"), (20_005, long + "1"), (None, "alone")]
    found = exact_dedup.exact_duplicates(frame(spark, rows), all_digests=True).collect()
    assert sorted((tuple(r) for r in found), key=str) == brute_exact(rows)
    plain = exact_dedup.exact_duplicates(frame(spark, rows)).collect()
    assert sorted((tuple(r) for r in plain), key=str) == sorted((r[:4] for r in brute_exact(rows)), key=str)
    kept = exact_dedup.without_duplicates(frame(spark, rows)).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(r[0]) for r in brute_exact(rows) if r[3])
    assert exact_dedup.exact_duplicates(frame(spark, []), True).count() == 0


def test_tables_peel_to_the_difference():
    rng = np.random.default_rng(4)
    left = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (0, 1, 5, 100, 700, 3, 4000)]
    right = [np.concatenate([x[: len(x) // 2], rng.integers(0, 2**63, k, dtype=np.uint64)]) for x, k in zip(left, (0, 0, 2, 60, 5, 900, 1), strict=True)]
    a, b = fingerprints.Prints.of(left), fingerprints.Prints.of(right)
    read = fingerprints.Prints.read(a.texts)
    assert read.sizes == [len(x) for x in left] and all(set(x.tolist()) == set(y.tolist()) for x, y in zip(read.listed, left, strict=True))
    for (p, q), x, y in zip(fingerprints.differences(read, fingerprints.Prints.read(b.texts)), left, right, strict=True):
        assert set(p.tolist()) == set(x.tolist()) - set(y.tolist()) and set(q.tolist()) == set(y.tolist()) - set(x.tolist())


def test_tables_grow_until_they_peel(monkeypatch):
    monkeypatch.setattr(fingerprints, "CELLS", 3)
    monkeypatch.setattr(fingerprints, "FOR_EACH", 0.3)
    lists = [np.unique(np.random.default_rng(k).integers(0, 2**63, 50, dtype=np.uint64)) for k in range(20)]
    made = fingerprints.Prints.of(lists)
    assert all(set(x.tolist()) == set(y.tolist()) for x, y in zip(made.listed, lists, strict=True)) and min(made.cells) > 18


def test_digests_of_repeats_and_edits():
    text = "one line here\n" * 50 + "another line\n"
    assert len(set(fingerprints.digests(text).tolist())) == 51
    assert not len(fingerprints.digests(""))
    rng = random.Random(5)
    long = "\n".join(prose(rng, 60) for _ in range(20))
    edited = long[:2000] + "changed" + long[2000:]
    a, b = set(fingerprints.digests(long).tolist()), set(fingerprints.digests(edited).tolist())
    assert len(a - b) <= 4 and len(a & b) > 50


def test_fingerprints(spark, corpus):
    rows = [*corpus, (20_000, "last text\nof all"), (None, "no id")]
    found = {r.doc_id: r for r in fingerprints.compare(frame(spark, rows), with_digests=True).collect()}
    assert len(found) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    prints = {}
    for k, (i, t) in enumerate(order):
        text, after = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(text) // 3
        edited = text[: len(text) - n] + after[:n]
        r = found[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = (set(fingerprints.digests(x).tolist()) for x in (text, edited, after))
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        assert r.near_edited == pytest.approx(like(a, b)) and r.near_next == pytest.approx(like(a, c))
        assert {int(d, 16) for d in r.edited_from} == a - b and {int(d, 16) for d in r.edited_to} == b - a
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        # the likeness is that of the two strings, without their texts
        mine, other = fingerprints.Prints.read([r.fingerprint]), fingerprints.Prints.read([r.edited_fingerprint])
        assert fingerprints.likenesses(mine, other) == [r.near_edited]
        assert (r.fingerprint == r.edited_fingerprint) == (a == b)


def test_fingerprints_of_one_and_of_no_row(spark):
    one = fingerprints.compare(frame(spark, [(3, "abc def")])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0 and one[0].edited_sha256 == hashlib.sha256(b"abc dab").hexdigest()
    assert fingerprints.compare(frame(spark, [])).count() == 0


def test_fingerprints_of_one_id(spark):
    """A doc_id that all rows share is spread over ranges of a hash, and every row has the next one."""
    rows = [(7 if k % 3 else None, f"text number {k} " * (k % 5 + 1)) for k in range(120)] + [(7, "copy")] * 30
    found = fingerprints.compare(frame(spark, rows)).collect()
    assert len(found) == 150 and sorted(r.n_chars for r in found) == sorted(len(t) for _, t in rows)
    copies = [r for r in found if r.n_chars == 4]
    assert len({r.fingerprint for r in copies}) == 1 and sum(r.near_next == 1.0 for r in copies) >= 29
    part, n = range_bucket(frame(spark, rows), "doc_id", 8)
    sizes = [r["count"] for r in frame(spark, rows).withColumn("p", part).groupBy("p").count().collect()]
    assert n >= 8 and max(sizes) < 80
