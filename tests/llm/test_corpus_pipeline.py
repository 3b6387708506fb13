"""Each stage of the pipeline beside what it must do, on the smallest tables."""

from __future__ import annotations

import itertools

import pytest

import corpus_pipeline
from fieldmill.llm import decontaminate, packing, queries, simhash, substring


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = [("documents", docs.toPandas())]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "packing":
            assert out.columns == docs.columns
            out = spark.createDataFrame(out.toPandas(), docs.schema)
        docs = out
        found.append((name, docs.toPandas()))
    return found


def test_order():
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_copies", "repeats", "test_items", "packing"]


def test_filters_keep_rows_as_they_are(stages):
    for (_, before), (name, after) in zip(stages, stages[1:]):
        if name in ("toxicity", "near_copies", "test_items"):
            merged = after.merge(before, how="left", on=list(before.columns), indicator=True)
            assert (merged["_merge"] == "both").all()


def test_near_copies_leave_no_equal_texts(stages):
    texts = dict(stages)["near_copies"].text
    assert texts.nunique() == len(texts)


def test_near_copies_are_the_components_of_the_operator(stages):
    before, after = dict(stages)["toxicity"], dict(stages)["near_copies"]
    pairs = [(int(d), simhash.fingerprint(t or "")) for d, t in zip(before.doc_id, before.text)]
    root = {d: d for d, _ in pairs}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for (a, fa), (b, fb) in itertools.combinations(pairs, 2):
        if (fa ^ fb).bit_count() <= 3:
            root[max(top(a), top(b))] = min(top(a), top(b))
    assert sorted(after.doc_id) == sorted({top(d) for d in root})


def test_no_passage_is_left_twice(stages):
    before, after = dict(stages)["near_copies"], dict(stages)["repeats"]
    assert sorted(before.doc_id) == sorted(after.doc_id)
    smallest = {}
    for doc_id, text in zip(before.doc_id, before.text):
        words = text.split()
        for i in range(len(words) - 12):
            window = tuple(words[i : i + 13])
            smallest[window] = min(smallest.get(window, doc_id), doc_id)
    kept = dict(zip(after.doc_id, after.text))
    for doc_id, text in zip(before.doc_id, before.text):
        words = text.split()
        gone = set()
        for i in range(len(words) - 12):
            if smallest[tuple(words[i : i + 13])] < doc_id:
                gone.update(range(i, i + 13))
        assert kept[doc_id].split() == [w for i, w in enumerate(words) if i not in gone]
    assert (after.n_chars == after.text.str.len()).all()


def test_no_test_item_is_left(spark, sf_dir, stages):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").toPandas().text.map(decontaminate.normalized)
    before, after = dict(stages)["repeats"], dict(stages)["test_items"]
    left = after.text.map(decontaminate.normalized)
    assert not any(item in text for text in left for item in items)
    gone = before[~before.doc_id.isin(after.doc_id)].text.map(decontaminate.normalized)
    for text in gone:
        assert any(decontaminate.distance(i, text)[0] <= decontaminate.budget(i) for i in items)


def test_everything_is_packed(stages):
    docs, pieces = dict(stages)["test_items"], dict(stages)["packing"]
    assert sorted(docs.doc_id) == sorted(pieces.doc_id.unique())
    assert pieces.length.sum() == pieces[pieces.start == 0].doc_tokens.sum()
    assert pieces.groupby("sequence_id").length.sum().max() <= packing.CAPACITY


def test_registered():
    assert len(queries.QUERIES) == 13
    assert {name.split("_")[0] for name in queries.QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert substring.OP6_SQL == queries.ORACLES["op6_substring_dedup"]
