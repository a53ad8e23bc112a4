"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import frame
from marketlens.llm import (
    co_training, decontamination, kneser_ney, near_dedup, packing, pii, quality_rules, suffix_dedup, token_counts, token_orc,
)
from marketlens.llm.common import scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, node long, start long, replaced int, `a.b` int, __key string, hash int, c0 string"
LONG = " ".join(f"word{n % 977} thing{n}" for n in range(12_000))
ROWS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta. Mail me@here.example or 10.1.2.3", "en", "s", 70, "x", 1, 2, 3, 4, "k", 5, "c"),
    (1, "alpha beta gamma delta epsilon zeta eta theta. Mail me@here.example or 10.1.2.3", "en", "s", 70, "x", 1, 2, 3, 4, "k", 5, "c"),
    (2, None, None, None, None, None, None, None, None, None, None, None, None),
    (3, "", "", "", 0, "", 0, 0, 0, 0, "", 0, ""),
    (4, " \t\n ", "en", "s", 4, "x", 1, 1, 1, 4, "k", 5, "c"),
    (5, LONG, "en", "s", len(LONG), "x", 1, 1, 1, 4, "k", 5, "c"),
    (6, LONG, "en", "t", len(LONG), "x", 1, 1, 1, 4, "k", 5, "c"),
    (7, "two words", "de", "s", 9, "x", 1, 1, 1, 4, "k", 5, "c"),
    (None, "no id but text of some words", "de", "s", 28, "x", 1, 1, 1, 4, "k", 5, "c"),
    (8, "Ünïcode ß 漢字 🙂 é", "xx", "s", 18, "x", 1, 1, 1, 4, "k", 5, "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, SCHEMA, *ROWS)


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return frame(spark, "doc_id long, quality int, toxic int", (1, 1, 0), (5, 1, 0), (7, 0, 0), (99, 0, 1), (None, 1, 0), (3, None, None))


@pytest.fixture(scope="module")
def benchmark(spark):
    return frame(spark, "item_id long, text string", (1, "quite another question of enough words to ask"), (2, None), (None, ""), (3, "hm"))


def orc(docs):
    path = scratch(docs.sparkSession, "t")
    token_orc.write_tokens(docs, path)
    rows = token_orc.read_tokens(docs.sparkSession, path)
    return token_orc.with_starts(token_orc.checksums(rows), rows)


def operators(labels, benchmark):
    return {
        "op1": suffix_dedup.digests, "op2": orc, "op3": lambda d: quality_rules.judged(d, labels),
        "op4": kneser_ney.held_out_scores, "op5": token_counts.token_counts, "op6": packing.packed,
        "op7": lambda d: co_training.scores(d, co_training.train(d, labels)), "op8": near_dedup.near_duplicates,
        "op9": lambda d: decontamination.contaminated(d, benchmark), "op10": pii.replaced,
    }


@pytest.mark.parametrize("name", [f"op{n}" for n in range(1, 11)])
def test_operator(name, docs, none, labels, benchmark):
    run = operators(labels, benchmark)[name]
    rows = run(docs).collect()
    if name not in ("op6", "op9"):
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted((d[0] is None, d[0] or 0) for d in ROWS)
    by_id = {r.doc_id: r for r in rows}
    if name == "op1":
        assert by_id[5].n_removed == by_id[6].n_removed == len(LONG) and by_id[1].n_removed == by_id[2].n_bytes == 0
    if name == "op2":
        assert by_id[2].n_tokens == by_id[3].n_tokens == by_id[4].n_tokens == 1
    if name == "op3":
        assert not by_id[2].kept and by_id[2].n_words == 0 and by_id[7].n_words == 2
    if name == "op4":
        assert by_id[2].n_tokens == by_id[3].n_tokens == 1 and all(r.score <= 0 for r in rows)
    if name == "op5":
        assert by_id[3].n_tokens == 1
    if name == "op6":
        assert sum(r.length for r in rows if r.doc_id == 3) == 1 and len([r for r in rows if r.doc_id == 5]) > 1
    if name == "op8":
        assert (by_id[6].component_id, by_id[6].kept, by_id[5].kept) == (5, False, True)
        assert by_id[2].kept and by_id[2].n_shingles == 0 and by_id[None].component_id is None
    if name == "op9":
        assert rows == []
    if name == "op10":
        assert by_id[2].text is None and by_id[3].text == "" and by_id[1].kinds == "email,ip"
    assert run(none).collect() == []


@pytest.mark.parametrize("number", range(5))
def test_stage(number, spark, docs, none, labels, benchmark, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    _, stage = corpus_pipeline.STAGES[number]
    got = stage(spark, docs, str(tmp_path))
    if number < 4:
        assert got.schema.names == docs.schema.names
    if number == 1:
        assert got.filter("doc_id = 1").count() == 1 and got.filter("doc_id IS NULL").count() == 1 and got.count() == 8
    if number in (2, 3):
        assert got.count() == len(ROWS)
    assert stage(spark, none, str(tmp_path)).count() == 0


def test_nothing_is_lost_when_a_bucket_is_hot(spark):
    """One passage in every text, with other words around it."""
    passage = "the same passage of more than fifty bytes that stands in every single one of the documents here " * 2
    rows = [(n, f"{n} start{n} {passage} end{n} {n * 7}", "en", "s", 1) for n in range(300)]
    docs = frame(spark, "doc_id long, text string, lang string, source string, n_chars long", *rows)
    before, suffix_dedup.HOT_RUNS = suffix_dedup.HOT_RUNS, 10
    try:
        hot = {r.doc_id: tuple(r) for r in suffix_dedup.digests(docs).collect()}
    finally:
        suffix_dedup.HOT_RUNS = before
    assert hot == {r.doc_id: tuple(r) for r in suffix_dedup.digests(docs).collect()}
    assert docs.select(F.max("doc_id")).first()[0] == 299
