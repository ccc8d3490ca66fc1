"""Stages that drop or change rows: nulls, empty and long texts, repeated ids, empty tables, and columns with clashing names."""

import pytest

from silvaspark.llm import exact_dedup, near_dedup, packing, secrets, toxicity

CLASH = ["_id", "_sha", "_sha_here", "_sig", "_gone_id", "_GONE_SHA", "_lost_sig", "_some", "kept", "sig", "id", "key", "k", "size", "component", "row", "col"]
SCHEMA = "doc_id long, text string, tag string, " + ", ".join(f"`{c}` string" for c in CLASH)


def words(letter, n=60):
    return " ".join(f"{letter}{i}" for i in range(n))


#: doc_id, text, a tag of the row.
ROWS = [
    (1, words("a"), "first"),
    (2, words("a"), "copy"),
    (2, words("b"), "other text of the same id"),
    (None, words("c"), "no id"),
    (None, words("c"), "no id again"),
    (3, None, "null"),
    (4, "", "empty"),
    (5, "  \n\t", "blank"),
    (6, words("a") + " z0 z1", "near"),
    (7, words("d", 60_000), "long"),
    (8, words("e") + " you idiot moron scum loser", "toxic"),
    (9, words("f") + " password = abcdef123456", "secret"),
    (9, words("g"), "same id as the secret"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, *[f"{c} of {r[2]}" for c in CLASH]) for r in ROWS], SCHEMA).repartition(3)


def labels(spark):
    return spark.createDataFrame([], "doc_id long, toxic int")


STAGES = {
    "toxicity": (lambda spark, d: toxicity.without_toxic(d, labels(spark)), {"toxic"}),
    "exact": (lambda spark, d: exact_dedup.without_duplicates(d), {"copy", "empty", "no id", "no id again"}),
    "near": (lambda spark, d: near_dedup.without_near_duplicates(d), {"copy", "near"}),
    "secrets": (lambda spark, d: secrets.without_secrets(d), set()),
}


@pytest.mark.parametrize("name", sorted(STAGES))
def test_stage(spark, docs, name):
    stage, gone = STAGES[name]
    after = stage(spark, docs)
    assert after.schema.simpleString() == docs.schema.simpleString()
    rows = after.collect()
    kept = {r.tag for r in rows}
    if name == "exact":  # rows without an id are equal and neither has the least one: both stay
        gone = gone - {"no id", "no id again"}
    assert kept == {r[2] for r in ROWS} - gone and len(rows) == len(kept)
    assert all(r[c] == f"{c} of {r.tag}" for r in rows for c in CLASH)
    texts = {r[2]: r[1] for r in ROWS}
    for r in rows:
        assert r.text == (words("f") + " [SECRET]" if name == "secrets" and r.tag == "secret" else texts[r.tag])
    assert stage(spark, docs.filter("false")).count() == 0


def test_pack_of_odd_rows(spark, docs):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = packing.pack(docs, path).collect()
    assert sum(r.start == 0 for r in rows) == len(ROWS) and packing.pack(docs.filter("false"), path).count() == 0
    assert {r.doc_id for r in rows} == {r[0] for r in ROWS}
