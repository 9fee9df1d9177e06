"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, for every operator and stage."""

import pytest
import odd_rows as odd

import corpus_pipeline
from mediaweave.llm import decontaminate, language, licenses, mixing, neardup, paragraphs, quality, repeats, tokens, warc


def bench(spark, empty=False):
    rows = [] if empty else [(1, " ".join(f"w{i}" for i in range(12))), (None, "one"), (3, None), (3, ""), (1, "w1 w2")]
    return spark.createDataFrame(rows, "item_id long, text string")


def pages(spark, docs):
    return docs.selectExpr("doc_id AS page_id", "lang AS url", "text AS html", "kept", "row", "size")


OPERATORS = {
    "quality": lambda s, d: quality.with_quality(d),
    "clean": lambda s, d: quality.clean_documents(d),
    "neardup": lambda s, d: neardup.near_duplicates(d),
    "without_near": lambda s, d: neardup.without_near_duplicates(d),
    "scan": lambda s, d: decontaminate.scan(d, bench(s)),
    "scan_empty_benchmark": lambda s, d: decontaminate.scan(d, bench(s, True)),
    "scan_blocks": lambda s, d: decontaminate.scan(d, bench(s), block_words=5),
    "decontaminate": lambda s, d: decontaminate.decontaminate(d, bench(s)),
    "language": lambda s, d: language.identify(d, language.train(d)),
    "repeats": lambda s, d: repeats.repeated_passages(d),
    "paragraphs": lambda s, d: paragraphs.duplicate_paragraphs(d),
    "without_paragraphs": lambda s, d: paragraphs.without_duplicate_paragraphs(d),
    "tokens": lambda s, d: tokens.token_table(d),
    "mix": lambda s, d: mixing.mix(d),
    "mixed": lambda s, d: mixing.mixed_documents(d),
    "licenses": lambda s, d: licenses.license_matches(d),
    "no_licenses": lambda s, d: licenses.license_matches(d, templates=[]),
    "warc": lambda s, d: warc.page_archive(s, pages(s, d)),
}
ROWS = {
    "quality": 15, "neardup": 15, "scan": 15, "scan_empty_benchmark": 15, "scan_blocks": 15, "language": 15,
    "without_paragraphs": 15, "tokens": 15, "mix": 15, "warc": 15, "no_licenses": 0,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    got = OPERATORS[name](spark, odd.table(spark)).collect()
    assert len(got) == ROWS.get(name, len(got))


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, odd.table(spark, [])).collect() == []


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_take_odd_rows(spark, sf_dir, k):
    docs = odd.table(spark)
    out = corpus_pipeline.STAGES[k][1](spark, docs, sf_dir)
    if k < len(corpus_pipeline.STAGES) - 1:
        assert out.dtypes == docs.dtypes
    assert out.count() > 0


def test_near_duplicates_among_odd_rows(spark):
    """The group of the base text is 5, 6 twice, 7, 10; texts without words and rows without an id are linked with nothing."""
    docs = odd.table(spark)
    got = sorted((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect() if r.doc_id is not None)
    alone = [(i, i, True) for i in (-11, 1, 2, 3, 4, 7, 8, 9)]
    assert got == sorted([*alone, (5, 5, True), (6, 5, False), (6, 5, False), (7, 5, False), (10, 5, False)])
    kept = neardup.without_near_duplicates(docs).collect()
    ids = sorted(r.doc_id for r in kept if r.doc_id is not None)
    assert ids == [-11, 1, 2, 3, 4, 5, 7, 8, 9] and sum(r.doc_id is None for r in kept) == 2
    given = {(r.doc_id, r.text) for r in docs.collect()}
    assert {(r.doc_id, r.text) for r in kept} < given


def test_no_licenses_among_odd_rows(spark):
    assert licenses.license_matches(odd.table(spark)).collect() == []
