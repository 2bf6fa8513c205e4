import hashlib
import random
from collections import Counter

from parlance.llm import suffix_array_dedup as m

SCHEMA = "doc_id long, text string, start int, packed string"


def brute(rows, length):
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    n = Counter(t[i : i + length] for _, t in texts for i in range(len(t) - length + 1))
    out = []
    for d, t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if n[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def fixture():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeéß") for _ in range(r.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    base, passage = text(200), text(40)
    docs = [base, base, base[:300] + "X" + base[301:], text(50) + passage + text(60), passage, text(10) + passage, "a" * 500, "ab" * 150, "", None, text(3), text(900), base[100:310]]
    docs += [base[: 150 + 7 * i] + word() + base[160 + 7 * i :] for i in range(30)]
    rows = [(i, t, 1, "x") for i, t in enumerate(docs)]
    return [*rows, (3, docs[3], 1, "x"), (None, text(80), None, None), (None, None, None, None), (4, text(60) + passage, 2, "y")]


def got(df):
    f = m.F
    n = f.aggregate("removed", f.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    rows = df.select("doc_id", f.octet_length("kept") + n, n, f.size("removed"), f.sha2("kept", 256)).collect()
    return sorted(map(tuple, rows), key=str)


def test_matches_brute_force(spark):
    rows = fixture()
    df = spark.createDataFrame(rows, SCHEMA)
    for length, gram in ((200, 32), (60, 12)):
        assert got(m.repeated_substrings(df, length, gram)) == brute(rows, length)


def test_large_ranks_go_on_as_rows(spark):
    rows = fixture()
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(m.repeated_substrings(df, 60, 12, rank_bytes=500)) == brute(rows, 60)


def test_empty_table(spark):
    assert m.repeated_substrings(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query(spark):
    from parlance.llm._common import read_table

    sf = "/root/testdata/sf0.001"
    rows = read_table(spark, sf, "documents").select("doc_id", "text").collect()
    assert sorted(map(tuple, m.op2_suffix_array_dedup(spark, sf).collect()), key=str) == brute(rows, 200)
