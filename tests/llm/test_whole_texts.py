"""Operators take the whole of each text into account."""

import random

import numpy as np
import pytest

from silvaspark.llm import fingerprints, near_dedup, secrets, toxicity


def test_every_byte_is_in_a_digest():
    rng = random.Random(1)
    for text in ("abcdefghij" * 90, "one two\n\n\nthree four\n", "some words here and " * 40, "中文字" * 300, "\n", " "):
        whole = fingerprints.digests(text).tolist()
        for at in {0, len(text) - 1, *(k for k in (255, 256, 257, 512, 513) if k < len(text)), *(rng.randrange(len(text)) for _ in range(40))}:
            other = text[:at] + ("\t" if text[at] in " \n" else "Z") + text[at + 1 :]
            assert fingerprints.digests(other).tolist() != whole, (text[:20], at)
    assert fingerprints.digests("a\n\nb").tolist() != fingerprints.digests("a\nb").tolist()


def test_near_stage_removes_rows_not_ids(spark):
    """A clean text stays though another row of its doc_id is a near copy; so do blanks."""
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(2, a, "x"), (5, a, "y"), (5, b, "z"), (5, " ", "w"), (7, a, "v"), (None, a, "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    found = near_dedup.without_near_duplicates(docs)
    assert found.columns == docs.columns
    assert sorted(r.kept for r in found.collect()) == ["u", "w", "x", "z"]


def test_terms_behind_marks_are_hits():
    hits = toxicity.Model({"idiot": True, "scum": False}).hits()
    names = lambda text: toxicity.features(text, hits)[1:5]
    for text in ("plain/idiot", "so,idiot", "well...idiot", "a_idiot", "(x)idiot", "好。idiot"):
        assert names(text) == pytest.approx([np.log(2), 0, 0, 0]), text
    assert names("scum/idiot") == pytest.approx([np.log(3), 0, 0, 0])
    assert names("you idi*t") == pytest.approx([0, 0, np.log(2), 0])  # a mark in place of a letter
    assert names('he,"scum/idiot" then') == pytest.approx([0, np.log(3), 0, 0])
    assert names('an open " mark idiot') == pytest.approx([np.log(2), 0, 0, 0])


def test_field_spans_go_on_beyond_base_spans():
    class Whole(secrets.Field):
        def viterbi(self, scores):
            return [secrets.BEGIN] + [secrets.INSIDE] * (len(scores) - 1)

        def may_gain(self, roles, shapes):
            return roles != secrets.EDGE

    made = secrets.made_lines(random.Random(5), 40)
    field = secrets.train(made, [["digits=0", "named=0"]] * len(made), rounds=2)
    finder = secrets.Finder(Whole(field.weights, field.steps, field.starts))
    text = "password=abc123!9f8e7d6c"
    base, more = finder.spans(text)
    assert base == [(0, 15, "assign")] and more == [(15, 24, "field")]
    assert secrets.masked(text, base + more, "*") == "**"
    assert secrets.beyond("ab cd ef", 0, 8, [(3, 5, "hex")]) == [(0, 2), (6, 8)]
    assert secrets.beyond("ab cd, ", 0, 6, [(0, 5, "hex")]) == []
