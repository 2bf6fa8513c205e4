import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from parlance.llm import phrase_mining as m

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, n long, phrase string, id long, left string"


def brute(docs, least=m.LEAST, longest=m.LONGEST, top=m.TOP):
    f, n = defaultdict(Counter), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda x: x[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", text):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, count in f.items():
        found = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in found.items()):
                continue
            score, k = min((2_000_000 * a // (count[p[:k]] + count[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -score) for i, (score, a, p, l, r) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def texts():
    rng = np.random.default_rng(3)
    words = ["the", "of", "New", "york", "city", "a", "b", "c", "É é", "ſ", "x'y", "\x1c", "…", "-"]
    odds = 1 / np.arange(1, len(words) + 1)
    out = []
    for i in range(400):
        w = rng.choice(words, int(rng.integers(0, 60)), p=odds / odds.sum()).tolist()
        gaps = rng.choice([" ", "\t", "  ", ". ", ",", "\n", " !? "], len(w), p=[0.7, 0.05, 0.05, 0.05, 0.05, 0.05, 0.05])
        out.append(("".join(a + b for a, b in zip(w, gaps)), [None, "und", "en", ""][i % 4]))
    out += [("in spite of it all", "en")] * 70 + [("spite of", "en")] * 40 + [(None, "en"), ("", None), (" \t\n.,", "de"), ("once only", "fr")]
    out.append(("one long text of words, " * 4000 + "tail " * 300, "en"))  # and a word that follows itself
    return out


def run(spark, docs, **how):
    df = spark.createDataFrame([(i, t, l, 1, "p", 2, "x") for i, (t, l) in enumerate(docs)], SCHEMA)
    return sorted(map(tuple, m.collocations(df, **how).drop("cut").collect()))


@pytest.mark.parametrize(("block_bytes", "bucket_bytes", "group"), [(m.BLOCK_BYTES, m.BUCKET_BYTES, m.GROUP), (300, 5000, 7)])
def test_matches_brute_force(spark, block_bytes, bucket_bytes, group):
    got = run(spark, texts(), block_bytes=block_bytes, bucket_bytes=bucket_bytes, group=group)
    assert got == brute(texts()) and len(got) > 50


def test_other_lengths_and_limits(spark):
    assert run(spark, texts(), least=12, longest=6, top=9) == brute(texts(), 12, 6, 9)
    assert run(spark, texts(), longest=2) == brute(texts(), longest=2)


def test_covered_at_exactly_the_share_goes(spark):
    docs = [("aa bb cc", "en")] * 80 + [("aa bb", "en")] * 20 + [("dd ee ff", "en")] * 79 + [("dd ee", "en")] * 21
    phrases = [r[2] for r in run(spark, docs)]
    assert "aa bb" not in phrases and "dd ee" in phrases and "aa bb cc" in phrases


def test_scores_beyond_64_bits(spark):
    df = spark.createDataFrame([(9 * 10**17, [9 * 10**17 + 5, 10**18], [2 * 10**18, 9 * 10**17 + 8])], "f long, firsts array<long>, lasts array<long>")
    from pyspark.sql import functions as F

    x = df.select(F.expr(m._CUT.format(scale=m.SCALE)).alias("x")).first().x
    assert (x.score, x.cut) == min((2_000_000 * 9 * 10**17 // s, k) for k, s in ((1, 18 * 10**17 + 13), (2, 3 * 10**18)))


def test_no_phrases(spark):
    assert run(spark, []) == [] and run(spark, [(None, None), ("a b", "en")]) == []


def test_query_against_duckdb(spark):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    rel = duck.sql(m.ORACLE_SQL)
    got = sorted(map(tuple, m.op13_phrase_mining(spark, SF).select(*rel.columns).collect()))
    assert got == sorted(rel.fetchall()) and len(got) > 40
