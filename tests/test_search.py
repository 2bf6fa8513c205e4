"""Search against the full-text index of SQLite, and golden cases."""

import random
import sqlite3

import pytest

from parlance.operators import search as s


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(2)
    words = ["budget", "Plan", "García", "niño", "don't", "co-op", "Straße", "roadmap", "ship", "10.5", "a_b", "Ünder", "the", "the", "of"]
    return [(i, i % 40, " ".join(r.choice(words) + r.choice(["", "", ".", ":", ","]) for _ in range(r.randint(1, 40)))) for i in range(400)]


@pytest.fixture(scope="module")
def fts(corpus):
    con = sqlite3.connect(":memory:")
    try:
        con.execute("CREATE VIRTUAL TABLE t USING fts5(text, tokenize='unicode61 remove_diacritics 2')")
    except sqlite3.OperationalError:
        pytest.skip("this SQLite has no FTS5")
    con.executemany("INSERT INTO t(rowid, text) VALUES (?, ?)", [(i + 1, x) for i, _, x in corpus])
    return con


@pytest.mark.parametrize("query", ["budget", "garcia", "nino plan", "don't", "roadmap ship", "10.5", "a_b", "under", "strasse", "the", "co-op", 'design"', "*()^", ""])
def test_ranks_and_snippets_match_fts5(spark, corpus, fts, query):
    df = spark.createDataFrame([(i, m, 0, x) for i, m, x in corpus], "seg_id long, meeting_id long, start_ms long, text string")
    rows = s.with_snippets(s.scored(df, query), query).collect()
    got = {r.seg_id: (r["rank"], r.snippet) for r in rows}
    match = " ".join(f'"{w}"' for w in s.sanitised(query))
    if not match:
        assert not got
        return
    want = fts.execute("SELECT rowid - 1, bm25(t), snippet(t, 0, '<mark>', '</mark>', '…', 16) FROM t WHERE t MATCH ?", (match,)).fetchall()
    assert set(got) == {i for i, *_ in want}
    for i, rank, snip in want:
        assert got[i][0] == pytest.approx(rank, abs=2e-9)
        assert got[i][1] == snip


def test_one_hit_a_meeting_and_limits(spark):
    rows = [(i, i // 3, 0, "budget review" if i % 3 else "budget budget budget budget") for i in range(15)]
    rows += [(100 + i, 100 + i, 0, "nothing of the sort") for i in range(40)]
    df = spark.createDataFrame(rows, "seg_id long, meeting_id long, start_ms long, text string")
    hits = s.search(df, "budget", 2).collect()
    assert len(hits) == 2 and all(h.text.count("budget") == 4 for h in hits)
    assert s.search(df, "budget", 0).count() == 5
    assert s.search(df, " ", 5).count() == 0


def test_snippet_escapes_text_but_not_marks():
    assert s.snippet('say <mark> & "budget" now', [["budget"]]) == 'say &lt;mark&gt; &amp; &quot;<mark>budget</mark>&quot; now'
