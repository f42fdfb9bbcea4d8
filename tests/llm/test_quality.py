import zlib

import numpy as np
import pytest

from actiscope.llm import quality as q

GOOD = [f"The {a} of the {b} was seen by a {c} near {a}." for a in ("house", "river", "garden", "road") for b in ("town", "king", "valley") for c in ("child", "dog", "friend")]
BAD = [t.upper().replace(" ", "!! ") + "%%% $$$" for t in GOOD]


def test_gradient_by_differences():
    net = q.ByteConvNet.initial(1)
    texts, labels = [b"hello world this is", b"x" * 300, b"", bytes(range(256)) * 3], np.array([1, 0, 1, 0], np.float32)
    grads, _ = q.gradient(net, texts, labels)
    for part, grad in zip(net.parts(), grads):
        i = int(np.abs(grad).argmax())
        held = part.ravel()[i]
        part.ravel()[i] = held + 1e-2
        above = q.gradient(net, texts, labels)[1]
        part.ravel()[i] = held - 1e-2
        below = q.gradient(net, texts, labels)[1]
        part.ravel()[i] = held
        assert grad.ravel()[i] == pytest.approx((above - below) / 2e-2, rel=0.02, abs=1e-4)


def test_score_is_that_of_each_text_alone():
    net = q.ByteConvNet.initial(2)
    texts = [b"", b"a", b"abc" * 200, bytes(range(256)) * 9, b"z" * 122]
    alone = [q.score(net, net.pairs(), [t])[0] for t in texts]
    assert q.score(net, net.pairs(), texts) == pytest.approx(alone, rel=1e-5)


def slow_score(net, text):
    """The model in plain loops."""
    n = max(1, -(-(len(text) + q.WIDTH) // q.HALF)) * q.HALF
    data = [0] * q.WIDTH + list(text) + [0] * (n - len(text))
    at = np.array([sum(net.filters[j, data[i + j]] for j in range(q.WIDTH)) for i in range(n)]) + net.offset
    half = np.maximum(at, 0).reshape(-1, q.HALF, q.FILTERS).max(axis=1)
    chunks = np.array([np.maximum(a, b) for a, b in zip(half, half[1:])]) if len(half) > 1 else half
    z = np.concatenate((chunks.max(axis=0), chunks.mean(axis=0))) @ net.output + net.bias[0]
    return 1 / (1 + np.exp(-z))


def test_score_against_loops():
    net = q.ByteConvNet.initial(3)
    for text in (b"", b"short", "ünï 漢".encode() * 70, b"ab" * 250):
        assert q.score(net, net.pairs(), [text])[0] == pytest.approx(slow_score(net, text), rel=1e-4)


def labelled(spark, make_docs, extra=()):
    texts = [t for pair in zip(GOOD, BAD) for t in pair]
    docs = make_docs([*enumerate(texts), *extra])
    return docs, spark.createDataFrame([(i, 1 - i % 2) for i in range(len(texts))] + [(None, 1), (3, None), (9999, 0)], "doc_id long, quality int")


def test_held_out_accuracy_and_odd_rows(spark, make_docs, no_docs):
    docs, labels = labelled(spark, make_docs, [(500, None), (501, ""), (None, "A null id of the house"), (502, "long " * 30000)])
    scored = q.with_quality(docs, q.fit(docs, labels)).collect()
    assert len(scored) == docs.count() and all(0 <= r.score <= 1 for r in scored)
    held = [r for r in scored if r.doc_id is not None and r.doc_id < 100 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 5 and np.mean([(r.score >= q.THRESHOLD) == (r.doc_id % 2 == 0) for r in held]) >= 0.9
    assert len({r.score for r in scored if not r.text}) == 1
    empty = q.fit(no_docs, labels)
    assert {r.score for r in q.with_quality(docs, empty).collect()} == {0.5} and q.with_quality(no_docs, empty).count() == 0


def test_held_out_labels_teach_nothing(spark, make_docs):
    docs, labels = labelled(spark, make_docs)
    turned = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - quality else quality end as quality")
    a, b = q.fit(docs, labels), q.fit(docs, turned)
    assert all((x == y).all() for x, y in zip(a.parts(), b.parts()))


def test_filter_keeps_columns(spark, make_docs):
    docs, labels = labelled(spark, make_docs)
    kept = q.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id % 2 for r in kept.collect()} == {0}


def test_bounds_of_training_rows(spark, make_docs):
    docs, labels = labelled(spark, make_docs)
    a = q.fit(docs, labels, max_rows=4)
    assert not all((x == y).all() for x, y in zip(a.parts(), q.fit(docs, labels).parts()))
    assert (q.fit(docs, labels, max_bytes=0).output == 0).all()
