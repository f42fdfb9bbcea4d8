import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from actiscope.llm import infill

PIECES = st.lists(st.sampled_from(["a", "bé", " ", "\n", "漢字", "<", ">", "S", "<P>", "<S", "M>", "\x1c", "\x85", "\t "]), max_size=25).map("".join)


def units(text):
    """Left to right, one at a time, without regular expressions."""
    space, out, at = set(" \t\n\x0b\x0c\r"), [], 0
    while at < len(text):
        end = at
        while end < len(text) and text[end] in space:
            end += 1
        while end < len(text) and text[end] not in space:
            end += 1
        out.append(text[at:end])
        at = end
    return out


def by_hand(text, doc_id):
    digest = hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()
    h = [int(g, 16) for g in re.findall(".{8}", digest)[:4]]
    parts = units(text)
    low, high = sorted((h[0] % (len(parts) + 1), h[1] % (len(parts) + 1)))
    p, m, s = "".join(parts[:low]), "".join(parts[low:high]), "".join(parts[high:])
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= 50:
        return len(parts), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(parts), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(parts), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@given(PIECES, st.integers(0, 10**6))
@settings(max_examples=300, deadline=None)
def test_one_text_against_units_by_hand(text, doc_id):
    assert infill.rearranged(text, infill.draws(doc_id)) == by_hand(text, doc_id)


def test_odd_documents_round_trip(spark, odd_docs, no_docs):
    made = infill.fill_in_middle(odd_docs).withColumn("again", infill.restored()).collect()
    assert sorted((str(r.doc_id), r.again) for r in made) == sorted((str(r.doc_id), r.text or "") for r in odd_docs.collect())
    assert {r.form for r in made if not r.again} == {"plain"} and {r.n for r in made if not r.again} == {0}
    assert len({(r.form, r.output) for r in made if r.doc_id == 10}) == 1
    assert infill.fill_in_middle(no_docs).count() == 0
    assert infill.draws(None) != infill.draws(0)


def test_marks_at_the_ends_of_parts(spark):
    texts = ["a < b <S c P> d", "<S <P M> S>", "x<P y<S z<M", ">P <", "<M> in the text", "<S>", "one<two>three four <"]
    rows = [(i, t) for i in range(40) for t in texts]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = infill.fill_in_middle(docs).withColumn("again", infill.restored()).collect()
    assert sorted((r.doc_id, r.again) for r in made) == sorted(rows)
    assert {r.form for r in made} == {"plain", "psm", "spm"}
    assert all(r.form == "plain" for r in made if "<M>" in r.again or "<S>" in r.again)


def test_a_very_long_text():
    text = "word  " * 300_000
    n, form, a, b, out = infill.rearranged(text, [100, 200_000, 0, 99])
    assert (n, form, a, b) == (300_001, "psm", 598, 6 * 199_900) and len(out) == len(text) + 9
