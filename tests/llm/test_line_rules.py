from collections import defaultdict

from tests.llm.conftest import SF
from veilframe.llm.line_rules import clean_lines
from veilframe.llm.queries import QUERIES


def base(text):
    text = text or ""
    w = text.encode().split()
    starts = defaultdict(list)
    for k in range(len(w) - 7):
        starts[tuple(w[k:k + 8])].append(k)
    covered = {p for v in starts.values() if len(v) > 1 for k in v for p in range(k, k + 8)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(len(x.decode()) for x in w), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed


def test_query_equals_brute_force(spark, real_docs):
    rows = QUERIES["op10_line_rules"](spark, SF).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows} == {i: base(t) for i, t in real_docs.items()}
    assert not any(r.kept and r.base_failed for r in rows)


def test_verdict_follows_the_labels(spark, table):
    rows = QUERIES["op10_line_rules"](spark, SF).join(table("labels"), "doc_id").where("NOT base_failed").collect()
    assert all(r.kept == bool(r.quality) for r in rows)


def test_no_python_on_the_path(spark, make_docs):
    plan = clean_lines(make_docs([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_lines_and_edges(make_docs):
    prose = "This line has words enough to stay where it stands."
    more = "Another one of ten words is here to make it pass."
    text = "\n".join([prose, prose.upper(), more, more.upper(), "Home | About | Contact", "Copyright by us, all rights reserved.", "no end mark here", "WOW!! BUY!! NOW!!", "  \t", prose])
    rows = [(1, text), (2, None), (3, ""), (4, "short."), (5, " \x0b\x0c\r\n"), (None, text), (6, "a b c d e f g h " * 30), (6, "a b c d e f g h " * 30)]
    got = {r.doc_id: r for r in clean_lines(make_docs(rows, extra=["words", "lines", "kept", "good"])).collect()}
    assert got[1].text.split("\n") == [prose, prose.upper(), more, more.upper(), prose] and got[1].kept and got[1].n_dup_lines == 1
    assert [(got[i].n_words, got[i].kept, got[i].text) for i in (2, 3, 5)] == [(0, False, "")] * 3
    assert got[4].base_failed and got[6].n_repeat_words == 240 and got[6].base_failed and got[None].kept
    assert clean_lines(make_docs([])).collect() == []


def test_very_long_text(make_docs):
    text = " ".join(f"w{i % 50_000}" for i in range(150_000)) + "."
    row = clean_lines(make_docs([(1, text)])).first()
    assert (row.n_words, row.n_repeat_words) == base(text)[:1] + base(text)[4:5]
