import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tests.llm.conftest import SF
from veilframe.llm import packing as P
from veilframe.llm.queries import QUERIES

WHOLE = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text):
    return np.array([*WHOLE.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def check(rows, docs):
    """Every id lies in one piece, and every sequence is gapless from 0."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(docs)
    for i, own in by_doc.items():
        ids, at = ids_of(docs[i]), 0
        for r in sorted(own, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    return by_sequence


def test_query_round_trip(spark, real_docs):
    rows = QUERIES["op2_packing"](spark, SF).collect()
    sequences = check(rows, real_docs)
    assert sum(r.length for r in rows) / (1024 * len(sequences)) > 0.98


def test_fast_ids_equal_the_tokenizer_file(real_docs):
    odd = ["<|endoftext|>", "a<|endoftext|>b", "日本語 text", "naïve  \n\n  x", "it's 12 3.4!", "’tis — \U0001f600", " \t ", "ſtrange", "٣", "á", "x" * 5000]
    for text in [*odd, *real_docs.values()]:
        assert P.token_ids(text).tolist() == WHOLE.encode(text, add_special_tokens=False).ids


def test_best_fit_takes_the_tightest_window():
    rng = random.Random(2)
    for _ in range(20):
        lengths = np.array([rng.randrange(1, 33) for _ in range(rng.randrange(60))], np.int64)
        window, offset = P.best_fit_decreasing(lengths, 32)
        free, expected = [], {}
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            fit = min((f for f in free if f >= lengths[i]), default=None)
            if fit is not None:
                free.remove(fit)
            free.append((32 if fit is None else fit) - lengths[i])
            expected[i] = 0 if fit is None else 32 - fit
        assert [int(x) for x in offset] == [int(expected[i]) for i in range(len(lengths))]
        assert len(set(window.tolist())) == len(free)


def test_edges(make_docs):
    docs = {1: None, 2: "", 3: "word " * 5000, 4: "a", 5: "a", None: "b c"}
    check(P.pack(make_docs(docs.items(), extra=["bin", "length"])).collect(), docs)
    assert P.pack(make_docs([])).collect() == []
    twice = P.pack(make_docs([(1, "a b"), (1, "a b")])).collect()
    assert len(twice) == 2 and len({(r.sequence_id, r.offset) for r in twice}) == 2


def test_several_bins(make_docs):
    docs = {i: "word " * (i % 50) for i in range(200)}
    rows = P.pack(make_docs(docs.items()), per_bin=40, ids=True).collect()
    check(rows, docs)
    assert len({r.sequence_id >> 40 for r in rows}) == 5
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
