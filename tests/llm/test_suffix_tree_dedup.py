import hashlib
import random
import re

from parlance.llm import suffix_tree_dedup as m

SCHEMA = "doc_id long, text string, row int, prefix string"


def brute(rows, window):
    words = [(d, re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode())) for d, t, *_ in rows]
    order = lambda d: m.LAST if d is None else d
    least = {}
    for d, w in words:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            least[k] = min(order(d), least.get(k, m.LAST))
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < order(d):
                gone[i : i + window] = [True] * window
        out.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def fixture():
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdeéß ") for _ in range(r.randint(1, 3)))
    words = lambda n: [word() for _ in range(n)]
    base, passage = words(200), words(60)
    docs = [base, base, base[:90] + ["X"] + base[91:], words(50) + passage + words(60), passage, words(10) + passage, ["a"] * 300, ["a"] * 80, [], words(3), passage + passage + words(9)]
    docs += [base[: 50 + 5 * i] + words(1) + base[51 + 5 * i :] for i in range(25)]
    rows = [(100 - i, r.choice([" ", "\n", "\t "]).join(t), 1, "x") for i, t in enumerate(docs)]
    return [*rows, (97, rows[3][1], 1, "x"), (None, " ".join(passage), None, None), (None, None, None, None), (5, None, 1, ""), (96, " ".join(words(60) + passage), 2, "y")]


def got(df):
    f = m.F
    n = f.aggregate("removed", f.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return sorted(map(tuple, df.select("doc_id", "n_words", n, f.sha2("kept", 256)).collect()), key=str)


def test_matches_brute_force(spark):
    rows = fixture()
    df = spark.createDataFrame(rows, SCHEMA)
    for window, gram in ((50, 8), (12, 3)):
        assert got(m.repeated_passages(df, window, gram)) == brute(rows, window)


def test_large_prefixes_are_made_longer(spark):
    rows = fixture()
    assert got(m.repeated_passages(spark.createDataFrame(rows, SCHEMA), 12, 3, tree_windows=10)) == brute(rows, 12)


def test_empty_table(spark):
    assert m.repeated_passages(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = m.c.read_table(spark, sf, "documents").select("doc_id", "text").collect()
    assert sorted(map(tuple, m.op10_suffix_tree_dedup(spark, sf).collect()), key=str) == brute(rows, 50)
