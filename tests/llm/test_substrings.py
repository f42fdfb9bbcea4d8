import random
import re

import numpy as np
import pytest

from actiscope.llm import substrings as S


def brute(rows, window):
    """Removed words by a dictionary of windows in order of (id, start); rows alike in id and text are one."""
    seen, out = {}, {}
    for doc, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        words, gone = re.findall(r"[^\x20\x09-\x0D]+", text or ""), set()
        for i in range(len(words) - window + 1):
            if tuple(words[i : i + window]) in seen:
                gone.update(range(i, i + window))
            else:
                seen[tuple(words[i : i + window])] = doc
        out[doc] = (len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone))
    return out


def found(docs, **settings):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in S.without_repeats(docs, **settings).collect()}


@pytest.mark.parametrize(("window", "gram"), [(20, 4), (5, 2), (3, 3), (7, 1)])
def test_dense_repeats(make_docs, window, gram):
    draw = random.Random(window)
    rows = [(i, " ".join(draw.choice("ab") for _ in range(draw.randint(0, 60)))) for i in range(150)]
    assert found(make_docs(rows), window=window, gram=gram) == brute(rows, window)


@pytest.mark.parametrize("share", [1, 10**9])
def test_slices_and_buckets(make_docs, monkeypatch, share):
    """With all repeated words as common ones, and with none."""
    monkeypatch.setattr(S, "COMMON_SHARE", share)
    monkeypatch.setattr(S, "SLICE_CHARS", 300)
    draw = random.Random(2)
    passage = " ".join(f"p{i}" for i in range(55))
    rows = [(i, " ".join([*(f"w{draw.randint(0, 4000)}" for _ in range(draw.randint(0, 80))), passage, *(f"w{draw.randint(0, 4000)}" for _ in range(30))])) for i in range(60)]
    got = found(make_docs(rows))
    assert got == brute(rows, 20) and sum(n for _, n, _ in got.values()) >= 59 * 55


def test_odd_documents(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    out = S.without_repeats(odd_docs)
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in out.collect()]
    assert len(got) == len(rows) and {g[0]: g[1:] for g in got} == brute(rows, 20)
    assert len({g for g in got if g[0] == 10}) == 1
    assert set(odd_docs.columns) <= set(out.columns) and len(set(out.columns)) == len(out.columns)
    assert S.without_repeats(no_docs).count() == 0


def test_equal_hashes_are_told_apart():
    ids = np.array([1, 2, 3, 1, 2, 3, 1, 2, 4, 1, 2, 4], np.int32)
    places = np.array([0, 3, 6, 9])
    earlier, stands = S.repeated(ids, places, (np.array([5, 4, 1, 2]), np.zeros(4, int)), 3, np.zeros(4, np.uint64))
    assert earlier.tolist() == [True, False, False, True] and stands.tolist() == [False, True, True, False]


def test_planes_round_trip():
    for values in ([], [0], [0, 0], [1, 300, -5, 1 << 40]):
        got, at = S.unpack_planes(b"x" + S.planes(np.array(values, np.int64)), 1)
        assert got.tolist() == values and at == len(S.planes(np.array(values, np.int64))) + 1


def test_untouched_texts_stay(make_docs):
    passage = " ".join(f"p{i}" for i in range(30))
    docs = make_docs([(1, "kept\n as  it\tis"), (2, passage), (3, "before\n" + passage + "  after"), (4, None)])
    out = S.cut_repeats(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: (r.text, r.n_chars) for r in out.collect()} == {1: ("kept\n as  it\tis", 15), 2: (passage, len(passage)), 3: ("before after", 12), 4: (None, None)}


def test_query_on_table(spark, sf_dir):
    import hashlib

    from actiscope.llm.queries import op10

    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = sorted((d, n, m, hashlib.sha256(t.encode()).hexdigest()) for d, (n, m, t) in brute(rows, 20).items())
    assert sorted(map(tuple, op10(spark, sf_dir).collect())) == want


def test_words_hold_one_document_at_a_time():
    import weakref

    class Words(list):
        """A list that can be looked after."""

    seen, held = [], []

    def docs():
        for i in range(6):
            doc = Words([b"a", b"b%d" % i])
            seen.append(weakref.ref(doc))
            held.append(sum(r() is not None for r in seen))
            yield doc
            del doc

    w = S.Words(docs())
    assert w.lengths.tolist() == [2] * 6 and w.ids.tolist() == [0, 1, 0, 2, 0, 3, 0, 4, 0, 5, 0, 6]
    assert max(held) <= 2
