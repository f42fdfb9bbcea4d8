import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest
from pyspark.sql import functions as F

from actiscope.llm import lm, quality


def vocabulary(counts, ends):
    words = sorted(counts, key=lambda w: (-counts[w], w))
    mass = np.full(lm.REST_CLASSES, 0.5)
    for w in words[lm.LEARNED - 1 :]:
        mass[lm.rest_class(w)] += counts[w] + 0.5
    return lm.Vocabulary(words, np.array([counts[w] for w in words], np.int64), ends, sum(counts.values()) + ends, len(counts) + 1, mass)


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(lm, "LEARNED", 12)
    monkeypatch.setattr(lm, "CLASSES", 4)
    counts = Counter({f"w{i}".encode(): 60 - 3 * i for i in range(20)})
    v = vocabulary(counts, 10)
    net = lm.Network.initial(v, 1)
    return v, lm.Network(*(p.astype(np.float64) for p in net.parts()))


def test_probabilities_sum_to_one(small):
    v, net = small
    h = np.random.default_rng(0).normal(size=(1, lm.HIDDEN))
    targets = np.arange(v.size + lm.REST_CLASSES)
    p = np.exp(lm.output_log_p(net, v, np.repeat(h, len(targets), axis=0), targets))
    assert p.sum() == pytest.approx(1)
    # Within a class of the rest: its words and one unseen word share its mass.
    rest = Counter()
    for w, c in zip(v.words[lm.LEARNED - 1 :], v.counts[lm.LEARNED - 1 :]):
        rest[lm.rest_class(w)] += (c + 0.5) / v.rest_mass[lm.rest_class(w)]
    assert all(share + 0.5 / v.rest_mass[k] == pytest.approx(1) for k, share in rest.items())


def test_gradient_by_differences(small):
    v, net = small
    docs = [np.array([0, 3, 15, v.end]), np.array([2, 2, 7, 1, 20, v.end]), np.array([5, v.end])]
    x, target, begins, place = next(lm.windows(v, docs, 2, 16))
    h = np.random.default_rng(1).normal(size=(x.shape[1], lm.HIDDEN))
    run = lambda: lm.window_gradient(net, v, h, x, target, begins, place >= 0)
    for part, grad in zip(net.parts(), run()[0]):
        for i in np.argsort(-np.abs(grad).ravel())[:3]:
            held = part.ravel()[i]
            part.ravel()[i] = held + 1e-5
            above = run()[2]
            part.ravel()[i] = held - 1e-5
            below = run()[2]
            part.ravel()[i] = held
            assert grad.ravel()[i] == pytest.approx((above - below) / 2e-5, rel=1e-4, abs=1e-7)


def slow_score(net, v, doc):
    h, x, total = np.zeros((1, lm.HIDDEN)), v.size + lm.REST_CLASSES, 0.0
    for t in doc:
        h, _ = lm.step(net, h, np.array([x]))
        total += lm.output_log_p(net, v, h, np.array([t]))[0]
        x = t
    return total


def test_state_is_carried_through_whole_documents(small, monkeypatch):
    v, net = small
    monkeypatch.setattr(lm, "SCORE_LANES", 3)
    draw = np.random.default_rng(2)
    docs = [np.append(draw.integers(0, v.size + lm.REST_CLASSES, n), v.end) for n in (0, 1, 15, 16, 17, 90, 200, 3)]
    assert lm.score_documents(net, v, docs) == pytest.approx([slow_score(net, v, d) for d in docs])


def test_training_learns_an_order(small):
    v, net = small
    docs = [np.array([0, 1, 2, 3] * 12 + [v.end]) for _ in range(1500)]
    net32 = lm.Network(*(p.astype(np.float32) for p in net.parts()))
    trained, log = lm.train(net32, v, docs, 0.02)
    assert np.mean(log[-5:]) < 0.3 * np.mean(log[:3])
    assert lm.score_documents(trained, v, docs[:1])[0] > 0.4 * lm.score_documents(net32, v, docs[:1])[0]


def check(rows, found):
    words = lambda text: [w.translate({c: c + 32 for c in range(65, 91)}).encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    tokens = [(doc, words(text) + [None]) for doc, text in rows]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    count = Counter(w for d, ws in tokens if not held(d) for w in ws)
    n, v = sum(count.values()), len(count)
    want = sorted(((d, held(d), len(ws), sum(count[w] > 0 for w in ws), n, round(sum(log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for d, ws in tokens), key=repr)
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found), key=repr)
    assert got == want


def test_counts_and_base_of_odd_documents(odd_docs, no_docs, monkeypatch):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    found = lm.log_likelihood(odd_docs, quality.fold() == 1).collect()
    check(rows, found)
    assert all(r.score < 0 for r in found) and len({r.score for r in found if r.doc_id == 10}) == 1
    assert lm.log_likelihood(no_docs, quality.fold() == 1).count() == 0
    none = lm.log_likelihood(odd_docs, F.lit(True)).collect()
    assert {r.train_tokens for r in none} == {0} and all(abs(r.base_score) < 1e-9 and r.n_known == 0 for r in none)


@pytest.mark.parametrize("frequent", [200_000, 700])
def test_query_on_table(spark, sf_dir, monkeypatch, frequent):
    """With all words held by the tasks, and with most looked up by the join."""
    from actiscope.llm.queries import op9

    monkeypatch.setattr(lm, "FREQUENT", frequent)
    found = op9(spark, sf_dir).collect()
    check([tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()], found)
    assert sum(r.score for r in found if r.held_out) > sum(r.base_score for r in found if r.held_out)


@pytest.mark.parametrize("task_tokens", [500_000, 40])
def test_every_training_document_teaches(make_docs, monkeypatch, task_tokens):
    """A word's input weights move only when a document with it is trained on; here each document has its own words."""
    monkeypatch.setattr(lm, "TRAIN_TOKENS", task_tokens)
    seen, fit = {}, lm.fit

    def kept(docs, v, *args, **settings):
        seen["v"], seen["net"] = v, fit(docs, v, *args, **settings)
        return seen["net"]

    monkeypatch.setattr(lm, "fit", kept)
    docs = make_docs([(i, f"own{i} other{i} " * 10) for i in range(30)])
    assert lm.log_likelihood(docs, F.col("doc_id") >= 25).count() == 30
    v, moved = seen["v"], np.abs(seen["net"].embed - lm.Network.initial(seen["v"]).embed).max(axis=1)
    at = {w: v.target[i] for i, w in enumerate(v.words)}
    assert len(at) == 50 and all(moved[at[f"own{i}".encode()]] > 0 for i in range(25))


def test_gates_are_blocks_of_memory(small):
    """A step works on whole blocks, whose rows are as long as there are lanes, not on slices of sixteen."""
    v, net = small
    h = np.random.default_rng(3).normal(size=(lm.HIDDEN, 7))
    after, kept = lm.advance(net, h, lm.given_rows(net, np.arange(7)[None])[0])
    assert all(x.flags.c_contiguous and x.shape == (lm.HIDDEN, 7) for x in (after, *kept))
    assert lm.step(net, h.T, np.arange(7))[0].T == pytest.approx(after)


def test_large_logits_neither_overflow_nor_vanish():
    logits = np.array([[1000.0, -1000.0, 0.0], [999.0, -1001.0, 1.0]], np.float32)
    chosen, parts, total = lm.log_softmax_at(logits.copy(), np.array([0, 1, 1]))
    want = logits[[0, 1, 1], range(3)] - np.logaddexp(logits[0], logits[1])
    assert chosen == pytest.approx(want, abs=1e-4) and (parts / total).sum(axis=0) == pytest.approx([1, 1, 1])
