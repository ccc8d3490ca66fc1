"""Tokens, codes, files and packing against the libraries themselves."""

import hashlib
import random
import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from silvaspark.llm import byte_tokens, packing, piece_tokens, token_files
from silvaspark.llm.common import shared_dir

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
#: Empty, null, repeated, blank, odd and long texts; a null and a repeated doc_id; extra columns that clash.
ROWS = [(5, "the loser", 1), (2, None, 2), (2, "", 3), (None, "a  b\n\n c", 4), (7, "x" * 5000, 5), (9, " ", 6), (8, "wörd ▁ 中😀 <s> <|endoftext|>\t\x00", 7), (5, "the loser", 8), (1, "plain words\nin lines " * 400, 9)]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, n_tokens int").repartition(3)


def byte_ids(text):
    return [*Tokenizer.from_file(BYTES).encode(text or "", add_special_tokens=False).ids, 0]


PARTS = ["a", "b", " ", "  ", "\n", "the", "é", "▁", "中", "\r", "\t", "😀", "ing", "\x00", "▁▁", "{", "<s>", "<0x41>", "=", " " * 7, " " * 17, "loser"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join))
def test_pieces_are_the_library_s(text):
    of, library = piece_tokens.table(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    ids = library.encode(text)
    assert of.encode(text) == ids and of.decode(ids) == library.decode(ids)
    words = [w for w in of.spaced(text).split(" ") if len(w) <= piece_tokens.LONG]
    assert of.many_ids(words) == [of.word_ids(w) for w in words]
    assert [list(c) for c in of.many_counts(words)] == [list(of.word_counts(w)) for w in words]


def test_counts_of_every_prefix(library):
    of, rng = piece_tokens.table(PIECES), random.Random(1)
    for _ in range(80):
        text = "".join(rng.choice(PARTS) for _ in range(10))
        assert of.prefix_counts(text).tolist() == [len(library.encode(text[:i])) for i in range(len(text) + 1)]
        table, counts = of.prefix_table(text), [len(library.encode(text[:i])) for i in range(len(text) + 1)]
        assert [table.fits(n) for n in range(12)] == [max(i for i, c in enumerate(counts) if c <= n) for n in range(12)]
        assert table.total() == counts[-1]


def test_runs_of_spaces(library):
    """Pieces of runs are as the queue makes them, and their counts need no time beyond their length."""
    of = piece_tokens.table(PIECES)
    assert of.widest and all(of.run_ids(n) == [of.ids[p] for p in of.merged(piece_tokens.SPACE * n)] for n in range(1, 80))
    start = time.process_time()
    text = " " * 200_000 + "word" + " " * 50_000
    assert of.prefix_counts(text)[-1] == len(library.encode(text)) and of.fits(text, 100) == 1_599
    assert time.process_time() - start < 10


def test_budgets_without_encoding_again(docs, library):
    """One stored table of a text answers every budget."""
    rows = piece_tokens.count_tokens(docs, PIECES, 10, budgets=(3, 500, 10)).collect()
    assert rows[0].asDict().keys() == {"doc_id", "n_bytes", "n_tokens", "over_limit", "limit_chars", "fits_3", "fits_500"}
    texts = {(i, len((t or "").encode())): t or "" for i, t, _ in ROWS}
    for r in rows:
        text = texts[r.doc_id, r.n_bytes]
        for n, chars in ((10, r.limit_chars), (3, r.fits_3), (500, r.fits_500)):
            assert len(library.encode(text[:chars])) <= n and (chars == len(text) or len(library.encode(text[: chars + 1])) > n)


def test_merges_have_an_order():
    of = piece_tokens.table(PIECES)
    assert not of.odd and not of.never


def test_count_tokens(docs, library):
    found = sorted(tuple(map(str, r)) for r in piece_tokens.count_tokens(docs, PIECES, 1000).drop("limit_chars").collect())
    expected = [(i, len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > 1000) for i, t, _ in ROWS]
    assert found == sorted(tuple(map(str, r)) for r in expected)


def test_encode_decode(docs, library):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    found = sorted(tuple(map(str, r)) for r in piece_tokens.encode_decode(docs, PIECES).collect())
    codes = [(i, library.encode(t or "")) for i, t, _ in ROWS]
    assert found == sorted(tuple(map(str, (i, len(c), sha(",".join(map(str, c))), sha(library.decode(c))))) for i, c in codes)
    row = piece_tokens.encode_decode(docs.filter("doc_id = 7"), PIECES, with_ids=True).first()
    assert row.ids == library.encode("x" * 5000) and row.decoded == "x" * 5000


def test_byte_tokens_are_the_library_s():
    rng = random.Random(2)
    some = ["a", "b", " ", "\n", "the", "é", "'s", "'", "\r", "12", "²", "<|endoftext|>", "　", ".", "\xa0", " ", "_"]
    texts = ["".join(rng.choice(some) for _ in range(rng.randint(0, 9))) for _ in range(3000)]
    of = byte_tokens.ByteTokens(BYTES)
    assert of.encode(texts) == of.whole(texts)
    some += ["WORD", "Ünï", "ab's", "don't", "'s", "--", "\"", "_x", "1a", "a1"]
    texts = [" ".join(rng.choice(some) for _ in range(rng.randint(0, 9))) for _ in range(3000)]
    assert of.encode(texts) == of.whole(texts)
    byte_tokens.MEMO_WORDS, was = 50, byte_tokens.MEMO_WORDS
    try:
        assert byte_tokens.ByteTokens(BYTES).encode(texts[:500]) == of.whole(texts[:500])
    finally:
        byte_tokens.MEMO_WORDS = was


def test_ids_that_span_words_fall_back():
    """A vocabulary whose ids do not come apart at words is asked word by word."""
    of = byte_tokens.ByteTokens(BYTES)
    of.opens[:] = False
    texts = ["a1 b2 c3 d4", "x9 y8"]
    assert of.encode(texts) == of.whole(texts)


def test_token_files(spark, docs):
    found = [tuple(r) for r in token_files.token_files(docs, BYTES).collect()]
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at, expected = 0, []
    for i, t, _ in order:
        ids = np.array(byte_ids(t), "<u4")
        expected.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(found, key=lambda r: r[1]) == expected


def test_files_come_back(spark, docs):
    folder = shared_dir(spark, "test")
    manifest = token_files.write_tokens(docs.filter("doc_id in (5, 8)"), BYTES, folder, end_id=70_000)
    rows = token_files.read_tokens(spark, folder, manifest, with_ids=True).orderBy("start").collect()
    assert [r.ids for r in rows] == [[*byte_ids(t)[:-1], 70_000] for t in ("the loser", "the loser", ROWS[6][1])]
    assert token_files.write_tokens(docs.filter("false"), BYTES, shared_dir(spark, "none")) == []
    assert token_files.token_files(docs.filter("false"), BYTES).count() == 0


def test_packing(docs):
    rows = packing.pack(docs, BYTES, window=64, least=8).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id, r.doc_tokens].append(r)
        by_sequence[r.sequence_id].append(r)
    expected = defaultdict(list)  # rows of one doc_id and length share a key
    for i, t, _ in ROWS:
        expected[i, len(byte_ids(t))].append(np.array(byte_ids(t), "<u4"))
    assert by_doc.keys() == expected.keys()
    for key, texts in expected.items():
        pieces = sorted((r.start, r.length, r.ids_crc32) for r in by_doc[key])
        if len(texts) > 1:  # equal rows are documents of their own
            assert sum(p[1] for p in pieces) == sum(map(len, texts))
            continue
        at = 0
        for start, length, crc in pieces:
            assert start == at and crc == zlib.crc32(texts[0][at : at + length].tobytes())
            at += length
        assert at == len(texts[0])
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.step_group == pieces[0].step_group
            at += r.length
        assert at <= 64 and at & (at - 1) == 0 and {r.tier for r in pieces} == {at}


def test_tiers_are_packed():
    """Rests fill sequences of their own tier; gaps of long ones take rests of shorter tiers; at most one tier's worth waits."""
    packer, rng = packing.Packer(1024, 256), random.Random(3)
    lengths = [rng.choice([rng.randint(1, 256), rng.randint(257, 512), rng.randint(513, 1023), rng.randint(1024, 5000)]) for _ in range(600)]
    found = [s for k in range(0, 600, 100) for s in packer.pack((i, bytes(4 * lengths[i])) for i in range(k, k + 100))]
    sizes = [s[0] for s in found]
    assert set(sizes) == {256, 512, 1024} and all(sizes.count(n) > 20 for n in (512, 1024))
    for size, _, pieces in found:
        first = pieces[0]
        assert sum(p[2] for p in pieces) == size and (first[2] == 1024 or packer.tier(first[2]) == size)
        assert all(packer.tier(p[2]) <= size for p in pieces)
    waits = sum(packer.waiting.values())
    assert waits < 1024 + 512 + 256 and sum(sizes) + waits == sum(lengths)
    rest = [s[0] for s in packer.last()]
    assert sum(rest) == waits and all(n & (n - 1) == 0 for n in rest) and list(packer.last()) == []


def test_step_groups_are_even(spark):
    """Every group but a partition's last has the same tokens, with several sizes, and about the same cost."""
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, " ".join(["word"] * rng.choice([3, 20, 40, 90]))) for i in range(3000)], "doc_id long, text string").coalesce(1)
    packing.POOL, was = 8, packing.POOL
    try:
        rows = packing.pack(docs, BYTES, 64, 16, 8).collect()
    finally:
        packing.POOL = was
    groups = defaultdict(list)
    for r in rows:
        groups[r.step_group].append(r)
    tokens = {g: sum(r.length for r in x) for g, x in groups.items()}
    full = [g for g, n in tokens.items() if n == 512]
    assert max(tokens.values()) == 512 and len(full) > 0.9 * len(tokens)
    assert len({r.tier for r in rows}) >= 3
    longest = {g: len({r.sequence_id for r in x if r.tier == 64}) for g, x in groups.items()}
    cost = {g: sum(r.length**2 for r in x) for g, x in groups.items()}
    for g in range(0, len(full) // 8 * 8, 8):  # groups that were balanced together: as many sequences of the longest size, like costs
        assert max(cost[g + k] for k in range(8)) < 1.3 * min(cost[g + k] for k in range(8))
        assert max(longest[g + k] for k in range(8)) - min(longest[g + k] for k in range(8)) <= 1


def test_empty_tables(docs):
    none = docs.filter("false")
    assert piece_tokens.count_tokens(none, PIECES).count() == piece_tokens.encode_decode(none, PIECES).count() == packing.pack(none, BYTES).count() == 0
