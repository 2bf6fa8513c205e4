import random
import re

import numpy as np

from parlance.llm import decontamination as m
from parlance.llm._common import read_table

SCHEMA = "doc_id long, text string, item_id long, edits string"


def best_edits(item, x):
    """Least edits between the item and any part of x."""
    row = np.zeros(len(x) + 1, int)
    for i, ch in enumerate(item):
        new = np.minimum(row[1:] + 1, row[:-1] + (x != ch))
        new = np.concatenate([[i + 1], new])
        off = np.arange(len(new))
        row = np.minimum.accumulate(new - off) + off
    return int(row.min())


def brute(docs, items):
    out = set()
    for d, t in docs:
        for i, s in items:
            a = m.normalised(s or "")
            if 0 < len(a) < m.Q and t:
                plain = " ".join(t.lower().split())
                if re.search(r"(?<![^\W_])" + re.escape(" ".join(s.lower().split())) + r"(?![^\W_])", plain):
                    out.add((d, i, 0))
            elif len(a) and t:
                e = best_edits(a, m.normalised(t))
                if e <= m.budget(len(a)):
                    out.add((d, i, e))
    return out


def fixture():
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghijklmnoé") for _ in range(r.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(r.randint(12, 60))) for i in range(12)] + [(50, "too short"), (51, None), (52, " "), (53, text(30)[:21].strip() + "q"), (54, text(3)[:15].strip() + "q"), (55, text(5)[:26].strip() + "q"), (None, text(30))]
    docs = [(i, text(80)) for i in range(10)] + [(20, (text(9) + " ") * 400)]
    for i, (_, t) in enumerate(items[:12]):
        for rate in (0, 0.02, 0.045, 0.06, 0.12):
            x = list(t)
            for _ in range(int(rate * len(x))):
                at = r.randrange(len(x))
                r.choice([lambda: x.pop(at), lambda: x.insert(at, "z"), lambda: x.__setitem__(at, "q")])()
            docs.append((len(docs), r.choice(["", text(20) + "\n"]) + "".join(x).upper().replace(" ", r.choice([" ", "\n "])) + r.choice(["", " " + text(20)])))
    docs += [(900, None), (901, ""), (902, items[0][1]), (902, items[0][1]), (None, items[1][1] + " " + items[2][1]), (903, items[-1][1])]
    docs += [(910, "it is Too  short, or"), (911, "too shorter"), (912, "xtoo short"), (913, f"a {items[15][1][:9]}y{items[15][1][10:]} b"), (914, f"{items[15][1]} {items[16][1]}"), (915, f"{items[17][1][:9]}{items[17][1][10:]} b")]
    return docs, items


def test_matches_brute_force(spark):
    docs, items = fixture()
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert len(want) > 30
    for block in (m.BLOCK_CHARS, 300):
        rows = m.contaminated(df, bench, block_chars=block).collect()
        assert {(r.doc_id, r.item_id, r.edits) for r in rows} == want
        assert sum(r.doc_id == 902 for r in rows) == 2
    for r in rows:
        part = m.normalised(dict(docs)[r.doc_id])[r.start : r.end]
        assert best_edits(m.normalised(dict(items)[r.item_id]), part) == r.edits


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "a" * 100, 1, "")], SCHEMA)
    bench = spark.createDataFrame([(1, "a" * 100)], "item_id long, text string")
    assert m.contaminated(df.limit(0), bench).count() == 0
    assert m.contaminated(df, bench.limit(0)).count() == 0
    assert m.contaminated(df, bench).count() == 1


def test_query_finds_exact_passages(spark):
    sf = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in read_table(spark, sf, "documents").select("doc_id", "text").collect()]
    items = [tuple(r) for r in read_table(spark, sf, "benchmark").collect()]
    got = {(r.doc_id, r.item_id): r.edits for r in m.op3_decontamination(spark, sf).collect()}
    form = lambda t: " ".join(t.lower().split())
    exact = {(d, i) for d, t in docs for i, s in items if form(s) in form(t)}
    assert exact and exact == {k for k, e in got.items() if e == 0}


def test_bands_hold_all_windows_with_enough_hits():
    rng = np.random.default_rng(7)
    for _ in range(300):
        at = np.sort(rng.integers(0, 60, rng.integers(0, 40)))
        need, e = int(rng.integers(1, 9)), int(rng.integers(0, 6))
        want = set()
        for k in range(len(at) - need + 1):
            if at[k + need - 1] - at[k] <= e:
                want |= set(range(at[k] - e, at[k + need - 1] + e + 1))
        got = m.bands(np.bincount(at, minlength=61), need, e)
        assert {x for s, t in got for x in range(s, t)} == want


def test_repeated_characters_take_little_memory():
    import subprocess
    import sys

    code = "from parlance.llm import decontamination as m; i = m.Index.build(['a' * 2000, 'ab' * 500]); print(i.hits('a' * 200_000), m.__name__); import resource; print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split("\n")
    assert out[0].startswith("[(0, 0, 2000, 0)]") and int(out[1]) < 500_000  # KB
