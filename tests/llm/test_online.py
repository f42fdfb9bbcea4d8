import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from actiscope.llm import common, online
from actiscope.llm import queries as _  # noqa: F401

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def check_pieces(rows, ids_of, size):
    """Each document's ids once and in order, sequences without gaps or padding; gives pieces by document."""
    sequences, documents = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        documents[r.doc_id].append(r)
        assert 0 < r.length <= size
    for parts in sequences.values():
        parts.sort()
        at = 0
        for offset, n in parts:
            assert offset == at
            at += n
        assert at <= size and online.padded(at, size) == at
    for doc_id, ids in ids_of.items():
        at = 0
        for r in sorted(documents[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            at += r.length
            assert zlib.crc32(np.array(ids[r.start : at], "<u4").tobytes()) == r.ids_crc32
        assert at == len(ids)
    return documents


@given(st.lists(st.integers(1, 31), min_size=1, max_size=120))
@settings(max_examples=80, deadline=None)
def test_each_choice_makes_the_sum_of_squares_least(lengths):
    levels = online.Levels(32)
    for n in lengths:
        before = levels.count.copy()

        def after(level):
            count = before.copy()
            if level:
                count[level] -= 1
            if level + n < 32:
                count[level + n] += 1
            return int((count**2).sum())

        allowed = [0] + [h for h in range(1, 33 - n) if before[h]]
        level = levels.choose(n)
        assert level in allowed and after(level) == min(map(after, allowed))
        assert level == max(h for h in allowed if after(h) == after(level))
        levels.move(level, n)
        assert int((levels.count**2).sum()) == after(level) and levels.count[32] == 0 and levels.count[0] == 0


@given(st.lists(st.integers(1, 150), max_size=60), st.integers(1, 9))
@settings(max_examples=80, deadline=None)
def test_windows_hold_every_id_once_without_padding(lengths, most_open):
    packer, done = online.Packer(64, most_open), []
    texts = {i: np.arange(n, dtype="<u4") + 1000 * i for i, n in enumerate(lengths)}
    for i, ids in texts.items():
        done += packer.add(i, ids.tobytes())
        assert packer.n_open < most_open and packer.n_open == levels_sum(packer)
    done += packer.close()
    held = defaultdict(list)
    for window in done:
        n = sum(len(p[3]) for p in window) // 4
        assert online.padded(n, 64) == n <= 64
        for i, start, total, ids in window:
            assert total == lengths[i]
            held[i].append((start, np.frombuffer(ids, "<u4")))
    for i, ids in texts.items():
        assert np.concatenate([p for _, p in sorted(held[i], key=lambda x: x[0])]).tolist() == ids.tolist()


def levels_sum(packer):
    return int(packer.levels.count.sum())


def test_few_documents_are_cut():
    draw, packer = np.random.default_rng(1), online.Packer()
    windows = []
    for i in range(20_000):
        windows += packer.add(i, bytes(4 * int(draw.integers(1, 1025))))
    windows += packer.close()
    pieces = sum(map(len, windows))
    assert pieces < 20_000 * 1.15  # cutting the plain row of ids into windows makes about 1.5 pieces a document


def test_pieces_of_odd_documents(odd_docs, no_docs):
    rows = online.pack_online(odd_docs, PATH, 64, keep_ids=True).collect()
    texts = defaultdict(list)
    for r in odd_docs.collect():
        texts[r.doc_id].append(TOKENIZER.encode(r.text or "", add_special_tokens=False).ids + [0])
    alone = {i: t[0] for i, t in texts.items() if len(t) == 1}
    found = check_pieces(rows, alone, 64)
    assert sorted(r.start for r in found[10]) == sorted(2 * [r for r in range(0, len(texts[10][0]), 64)]) or sum(r.length for r in found[10]) == 2 * len(texts[10][0])
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    assert online.pack_online(no_docs, PATH).count() == 0
    with pytest.raises(ValueError):
        online.pack_online(no_docs, PATH, 1000)


def test_on_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    ids = {r.doc_id: TOKENIZER.encode(r.text or "", add_special_tokens=False).ids + [0] for r in docs}
    rows = common.QUERIES["op12_sum_of_squares"](spark, sf_dir).collect()
    check_pieces(rows, ids, 1024)
    assert len(rows) <= sum(-(-len(t) // 1024) for t in ids.values()) * 1.25
