import hashlib

import numpy as np
import pytest

from actiscope.llm import fingerprints as fp


def brute(text, k, w):
    """Smallest hash of every window, rightmost of equals, where it changes."""
    grams = [int(fp.rolling_hashes(np.frombuffer(text[i : i + k].encode("utf-32-le"), np.uint32), k)[0]) for i in range(len(text) - k + 1)]
    out = []
    for i in range(max(1, len(grams) - w + 1)):
        least = min(grams[i : i + w])
        at = i + max(j for j, x in enumerate(grams[i : i + w]) if x == least)
        if not out or out[-1] != (least, at):
            out.append((least, at))
    return out


@pytest.mark.parametrize(("k", "w"), [(16, 33), (5, 7), (7, 8), (1, 3), (2, 1)])
@pytest.mark.parametrize("text", ["ab" * 60, "the rain in spain falls mainly on the plain, 🙂 and so on and on " * 4, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "0123456789abcdefg"])
def test_windows_against_brute_force(text, k, w):
    hashes, positions = fp.winnow(text, k, w)
    assert list(zip(hashes.tolist(), positions.tolist())) == brute(text, k, w)


def test_short_and_empty_texts():
    assert [len(x) for x in fp.winnow("")] == [0, 0]
    assert fp.winnow("ab")[1].tolist() == [0]
    assert fp.likeness(*(np.array([], np.uint64),) * 2) == 1 and fp.likeness(fp.winnow("a")[0], np.array([], np.uint64)) == 0


def test_shared_run_is_guaranteed_a_match():
    draw = np.random.default_rng(1)
    word = lambda n: "".join(map(chr, draw.integers(97, 123, n)))
    for _ in range(20):
        run = word(fp.GRAM + fp.WINDOW - 1)
        a, b = fp.winnow(word(100) + run + word(80)), fp.winnow(word(37) + run + word(50))
        shared = set(a[0].tolist()) & set(b[0].tolist())
        assert shared
        places = {(int(p) - 100, int(q) - 37) for h, p in zip(*a) for g, q in zip(*b) if h == g}
        assert any(p == q for p, q in places)


def test_matches_give_positions(make_docs):
    run = "a passage of more than forty-eight characters that both of them hold in full"
    docs = fp.fingerprints(make_docs([(1, "first of all " + run), (2, "and then " + run), (3, None)]))
    found = fp.matches(docs.where("doc_id = 1"), docs.where("doc_id = 2")).collect()
    assert found and all(r.position_a - 13 == r.position_b - 9 for r in found)
    assert docs.where("doc_id = 3").first().fingerprint.hashes == []


def by_hand(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for (doc, text), (_, following) in zip(rows, rows[1:] + rows[:1]):
        text, following = text or "", following or ""
        q = len(text) // 4
        edited = text[: len(text) - q] + following[:q]
        a, b, c = fp.winnow(text), fp.winnow(edited), fp.winnow(following)
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), fp.written(*a), fp.written(*b), fp.likeness(a[0], b[0]), fp.likeness(a[0], c[0])))
    return sorted(out, key=repr)


def test_edits_of_odd_documents(odd_docs, no_docs, make_docs):
    want = by_hand([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert sorted(map(tuple, fp.fingerprint_edits(odd_docs).collect()), key=repr) == want
    assert fp.fingerprint_edits(no_docs).count() == 0
    assert sorted(map(tuple, fp.fingerprint_edits(make_docs([(4, "alone in the table")])).collect())) == by_hand([(4, "alone in the table")])


def test_query_on_table(spark, sf_dir):
    from actiscope.llm.queries import op1

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    found = op1(spark, sf_dir).collect()
    assert sorted(map(tuple, found), key=repr) == by_hand([tuple(r) for r in docs])
    assert np.mean([r.near_edited for r in found]) > 0.5 > 0.1 > np.mean([r.near_next for r in found])
