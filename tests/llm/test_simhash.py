import re

import numpy as np
import xxhash

from tests.llm.conftest import SF
from veilframe.llm import simhash
from veilframe.llm.base import Tables
from veilframe.llm.queries import QUERIES


def plain_fingerprint(text, size=4):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    size = min(size, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k:k + size]).encode(), 42) for k in range(len(words) - size + 1)]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def plain(rows, radius=4):
    """Fingerprint and component by brute force."""
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    low = {i: i for i, _ in prints}
    changed = True
    while changed:
        changed = False
        for i, x in prints:
            for j, y in prints:
                if low[j] > low[i] and (i == j or (x ^ y).bit_count() <= radius):
                    low[j], changed = low[i], True
    return sorted((i, f"{x:016x}", low[i]) for i, x in prints)


def test_query(spark, real_docs):
    rows = QUERIES["op11_simhash"](spark, SF).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, rows)) == plain(real_docs.items())


def test_hash_is_spark_s(spark):
    text = spark.range(1).selectExpr("xxhash64('one two three four') AS h").first().h
    assert text & (1 << 64) - 1 == simhash.fingerprint("One two\tTHREE\nfour") == plain_fingerprint("one two three four")


def test_edges(make_docs):
    long = "word " * 200_000 + "end"
    rows = [(9, None), (4, ""), (5, " \n"), (7, "One"), (8, "one"), (2, "Ä b c d e"), (3, "ä b c d e"), (6, "a b c"), (1, long), (11, long)]
    got = simhash.near_duplicates(make_docs([*rows, (None, "one"), (None, None)], extra=["fingerprint", "component", "strip"])).collect()
    assert sorted(tuple(r) for r in got if r.doc_id is not None) == plain(rows)
    assert sorted((r.fingerprint, r.component_id) for r in got if r.doc_id is None) == sorted([(f"{plain_fingerprint('one'):016x}", None), ("0" * 16, None)])
    assert simhash.near_duplicates(make_docs([])).collect() == []


def test_several_texts_of_one_document(make_docs):
    rows = [(1, "a b c d"), (2, "e f g h"), (3, "i j k l"), (5, "a b c d"), (5, "e f g h"), (5, "i j k l"), (6, "m n o p")]
    got = simhash.near_duplicates(make_docs(rows)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 1), (3, 1), (5, 1), (5, 1), (5, 1), (6, 6)]


def planted(seed, bases, copies):
    """Fingerprints with chains of neighbours up to 4 bits apart, one of them long."""
    rng = np.random.default_rng(seed)
    out = list(rng.integers(0, 1 << 64, bases, dtype=np.uint64))
    at = out[0]
    for k in range(copies):
        flips = rng.choice(64, rng.integers(1, 6), replace=False)
        at = (at if k % 3 else out[rng.integers(0, bases)]) ^ np.bitwise_or.reduce(np.uint64(1) << flips.astype(np.uint64))
        out.append(at)
    return np.unique(np.array(out, np.uint64))


def roots(prints, a, b):
    low = {x: x for x in prints.tolist()}

    def top(x):
        while low[x] != x:
            x = low[x]
        return x

    for x, y in zip(a, b, strict=True):
        x, y = top(int(x)), top(int(y))
        low[max(x, y)] = min(x, y)
    return {x: top(x) for x in low}


def close_pairs(prints, radius):
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= radius
    x, y = np.nonzero(np.triu(near, 1))
    return prints[x], prints[y]


def test_tiles_find_every_link():
    prints = planted(1, 1500, 1500)
    prints = prints[np.argsort(np.bitwise_count(prints), kind="stable")]
    for radius in (0, 3, 4):
        expected = roots(prints, *close_pairs(prints, radius))
        assert roots(prints, *simhash.linked(prints, None, radius)) == expected
        cut = 1100
        parts = [simhash.linked(prints[:cut], None, radius), simhash.linked(prints[cut:], None, radius), simhash.linked(prints[:cut], prints[cut:], radius)]
        assert roots(prints, np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])) == expected


def test_no_tile_is_skipped_wrongly():
    prints = planted(2, 3000, 0)
    boxes = simhash.Boxes(prints)
    for k in range(len(boxes.low)):
        least = boxes.least(k, boxes)
        for t in range(len(least)):
            x, y = prints[k * simhash.TILE:(k + 1) * simhash.TILE], prints[t * simhash.TILE:(t + 1) * simhash.TILE]
            assert np.bitwise_count(x[:, None] ^ y[None, :]).min() >= least[t]


def test_small_strips_over_partitions(spark):
    prints = planted(3, 1000, 2000)
    df = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fingerprint long").repartition(7)
    got = simhash.edges(df, Tables(spark, "simhash-test"), strip=128).collect()
    a, b = (np.array([r[k] for r in got], np.int64).view(np.uint64) for k in (0, 1))
    assert roots(prints, a, b) == roots(prints, *close_pairs(prints, 4))


def test_a_large_group_gives_few_edges():
    base = np.uint64(0x0123456789ABCDEF)
    bits = np.uint64(1) << np.arange(64, dtype=np.uint64)
    group = np.unique((base ^ (bits[:, None] | bits[None, :])).ravel())     # 2017 prints, any two within 4 bits
    a, b = simhash.linked(group, None, 4)
    assert len(a) == len(group) - 1 and len(set(roots(group, a, b).values())) == 1
