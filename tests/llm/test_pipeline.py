from collections import Counter, defaultdict

import pytest
import corpus_pipeline
import __spark_entry__ as entry
from actiscope.session import stored


def test_stages_on_their_own_input(spark, sf_dir):
    docs = corpus_pipeline.load(spark, sf_dir, "documents")
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    sizes = [len(before)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
        assert docs.columns == columns
        rows = docs.collect()
        assert {r.doc_id for r in rows} <= before.keys() and rows
        if name != "mixing":
            assert len(rows) <= sizes[-1]
        sizes.append(len(rows))
        if name in ("quality classifier", "n-gram jaccard join"):
            assert all(before[r.doc_id] == r for r in rows)
    assert sizes[1] < sizes[0] and sizes[2] < sizes[1]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    held = defaultdict(int)
    for r in packed:
        held[r.sequence_id] += r.length
    assert max(held.values()) <= 2048 and {r.doc_id for r in packed} == {r.doc_id for r in rows}


def test_run_is_registered(spark, sf_dir):
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.run(spark, sf_dir).count() > 0


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_odd_and_empty_tables(spark, sf_dir, odd_docs, no_docs, empty):
    """Nulls, empty, long and repeated texts, repeated rows, a null id and clashing columns, each stage on its own."""
    docs = no_docs if empty else odd_docs
    given = Counter((r.doc_id, r.text) for r in docs.collect())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        rows = out.collect()
        if name in ("quality classifier", "n-gram jaccard join"):
            assert not Counter((r.doc_id, r.text) for r in rows) - given, name
        if name == "n-gram jaccard join":
            same = [r for r in rows if r.text and r.text.startswith("the same text")]
            assert len(same) == (not empty) and sum(not (r.text or "").strip() for r in rows) == 3 * (not empty)
        if name == "substring dedup":
            assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in docs.collect())
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert pieces.count() >= sum(given.values()) or empty
