from collections import Counter

import duckdb
import pytest

from jobloom.llm.oracle import ORACLE
from jobloom.llm.quality_rules import Rule, apply_rules, keep_good

from .odd import WORD, empty, frame, rows


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if windows[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
    n = len(w)
    return {"n_words": n, "word_chars": sum(map(len, w)),
            "n_symbols": sum(text.count(c) for c in "#*$%&|<>"),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(hit),
            "base_failed": n < 20 or 100 * len(hit) > 30 * n}


@pytest.mark.parametrize("clashes", [False, True])
def test_counts_and_base_rules(spark, clashes):
    data = rows(long_words=30_000)
    got = apply_rules(frame(spark, data, clashes)).collect()
    want = Counter((r[0], *sorted(brute(r[1]).items())) for r in data)
    assert Counter((r.doc_id, *sorted((k, r[k]) for k in brute(""))) for r in got) == want
    assert all(not (r.base_failed and r.kept) for r in got)
    by = {r.doc_id: r for r in got}
    assert by[6].kept and not by[12].kept and not by[14].kept and not by[1].kept


def test_rule_table_is_a_parameter(spark):
    df = frame(spark, rows(long_words=0))
    got = apply_rules(df, base=(), rules=(Rule("few", "n_words", high=3),)).where("kept").collect()
    assert {r.doc_id for r in got} >= {1, 2, 3, 4, 5} and 6 not in {r.doc_id for r in got}
    assert apply_rules(df, base=(), rules=()).where("NOT kept").isEmpty()


def test_filter_keeps_rows_and_columns(spark):
    df = frame(spark, rows(long_words=0), clashes=True)
    kept = keep_good(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(7) == 2 and 6 in ids and 1 not in ids and 13 not in ids


def test_empty_table(spark):
    assert apply_rules(empty(spark)).count() == 0 and keep_good(empty(spark)).count() == 0


def test_sql_agrees_on_odd_rows(spark):
    data = rows(long_words=0)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in data])
    res = con.execute(ORACLE["op5_quality_rules"])
    names = [d[0] for d in res.description]
    got = apply_rules(frame(spark, data)).select(*names).collect()
    assert Counter(map(tuple, got)) == Counter(res.fetchall())
