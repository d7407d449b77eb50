import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tests.llm.conftest import SF
from veilframe.llm import alignment as al
from veilframe.llm.queries import QUERIES

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def byte_letters():
    """The letter that stands for each byte in the tokenizer file: itself if printable, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


LETTERS = byte_letters()


def plain_tokens(text):
    """(ids, bytes) of both sides, or None."""
    if not text:
        return None
    a = [(k, bytes(LETTERS[c] for c in A.id_to_token(k))) for k in A.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for k in B.encode(text):
        piece = B.id_to_piece(k)
        b.append((k, bytes([int(piece[3:5], 16)]) if B.is_byte(k) else piece.replace("▁", " ").encode()))
    data = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == data == b"".join(x for _, x in b) else None


def plain_groups(text):
    found = plain_tokens(text)
    if found is None:
        return [], 0, 0
    ends = []
    for side in found:
        at, own = 0, []
        for k, data in side:
            at += len(data)
            own.append((at, k))
        ends.append(own)
    common = sorted({e for e, _ in ends[0]} & {e for e, _ in ends[1]})
    groups, low = [], 0
    for c in common:
        groups.append(tuple([k for e, k in own if low < e <= c] for own in ends))
        low = c
    return groups, len(found[0]), len(found[1])


def plain(rows):
    made = [(doc, *plain_groups(t)) for doc, t in rows]
    count = Counter((a[-1], b[-1]) for _, groups, _, _ in made for a, b in groups)
    best = {}
    for (a, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for doc, groups, n_a, n_b in made:
        own = [(a[-1], b[-1]) for a, b in groups]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((doc, n_a, n_b, len(groups), len(own), sum(count[p] == best[p[1]] for p in own), sum(count[p] for p in own),
                    hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=str)


ODD = [None, "", " ", "a", "  two  spaces ", "line\nbreaks\r\n\tand tabs ", "<|endoftext|> is text, <s> too", "▁ mark", "日本語のテキスト", "émigré naïve Straße",
       "😀😀 emoji", "x" * 3000, "1234567890 3.14", "don't we'll I've", "end ", "\n", "\x00\x1f", "é a b c\u0085d", "a  b   c    d", "क्षत्रिय"]


def test_query(spark, real_docs):
    assert got(QUERIES["op12_token_alignment"](spark, SF)) == plain(real_docs.items())


def test_edges(make_docs):
    rows = [*enumerate(ODD), (3, "a"), (3, "a"), (None, "a b"), (None, None)]
    assert got(al.align(make_docs(rows, extra=["row", "seq", "pair", "a", "b"]))) == plain(rows)
    assert al.align(make_docs([])).collect() == []


def test_long_texts_in_small_chunks(make_docs, real_docs):
    rows = [*enumerate(ODD), *[(100 + k, t) for k, t in enumerate(list(real_docs.values())[:40])], (200, "no_white_space" * 400), (201, "line\n" * 500 + "end"),
            (202, "▁ mark " * 30)]
    assert got(al.align(make_docs(rows), chunk=40)) == plain(rows)


def test_cuts_are_safe():
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice(["a", "word", " ", "  ", "\n", "\t", "é", "'s", "12", "日", "😀", " ", "\x1c", ".", "<s>"]) for _ in range(rng.randrange(1, 40)))
        whole = al._tokens([0], [" " + text], [0], [" " + text])[0]
        found = al.chunks(text, 5)
        parts = [al._tokens([x], [a], [y], [b])[0] for x, a, y, b in found]
        if any(p is None for p in parts):
            assert whole is None
            continue
        together = al.NOTHING
        for p in parts:
            together = together + p
        assert all((x == y).all() for x, y in zip(together, whole, strict=True)), text


def same(x, y):
    return x.cut == y.cut and x.groups == y.groups and x.n_groups == y.n_groups and all(
        p.tolist() == q.tolist() for p, q in zip([*x.prefix, *x.suffix, x.pairs, x.times], [*y.prefix, *y.suffix, y.pairs, y.times], strict=True))


def test_composition_is_associative():
    rng = random.Random(5)
    for _ in range(200):
        text = "".join(rng.choice(["alignment", "tokenization", " ", "\n", "1234", "ß", "quick", ".", ","]) for _ in range(rng.randrange(4, 60)))
        t = al._tokens([0], [" " + text], [0], [" " + text])[0]
        n = rng.randrange(2, 7)
        # any cuts of the two token lists: A's and B's tokens of a fragment need not cover the same bytes
        at_a = sorted(rng.randrange(len(t.a) + 1) for _ in range(n - 1))
        at_b = sorted(rng.randrange(len(t.b) + 1) for _ in range(n - 1))
        parts = [al.fragment(al.Tokens(t.a[p:q], t.a_ends[p:q], t.b[r:s], t.b_ends[r:s]))
                 for p, q, r, s in zip([0, *at_a], [*at_a, None], [0, *at_b], [*at_b, None], strict=True)]
        whole = al.fragment(t)
        left = parts[0]
        for p in parts[1:]:
            left = al.compose(left, p)
        right = parts[-1]
        for p in parts[-2::-1]:
            right = al.compose(p, right)
        assert same(left, right) and same(left, whole)
        assert al.finished(left)[0] == al.finished(whole)[0]


@pytest.mark.parametrize("text", ["plain words", "déjà vu"])
def test_groups_text(text):
    t = al._tokens([0], [" " + text], [0], [" " + text])[0]
    groups = plain_groups(text)[0]
    assert al.finished(al.fragment(t))[0] == "".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) + ";" for a, b in groups)
