import re

import corpus_pipeline as p

from pyspark.sql import functions as F

from parlance.llm._common import read_table, stored
from tests.llm import test_decontamination as leaks
from tests.llm import test_jaccard_join as near

SF = "/root/testdata/sf0.001"
COLUMNS = list(p.COLUMNS)


def rows(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def cut(docs, window=50):
    """Texts without the words that a window covers which starts in an earlier document too."""
    spans = [[(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0d]+", (r[1] or "").encode())] for r in docs]
    words = [[(r[1] or "").encode()[a:b] for a, b in s] for r, s in zip(docs, spans)]
    least = {}
    for r, w in zip(docs, words):
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            least[k] = min(r[0], least.get(k, r[0]))
    out = []
    for r, w, s in zip(docs, words, spans):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < r[0]:
                gone[i : i + window] = [True] * window
        b = (r[1] or "").encode()
        keep = [True] * len(b)
        for i, g in enumerate(gone):
            if g:
                a = s[i][0]
                z = s[i + 1][0] if i + 1 < len(w) and gone[i + 1] else s[i][1]
                keep[a:z] = [False] * (z - a)
        text = bytes(x for x, k in zip(b, keep) if k).decode()
        if not any(gone):
            out.append(r)
        elif not all(gone):
            out.append((r[0], text, r[2], r[3], len(text)))
    return sorted(out, key=str)


def test_each_stage_against_brute_force(spark):
    docs = read_table(spark, SF, "documents")
    start = rows(docs)
    base = start[3][1]
    more = [(5000, base + " one more", "en", "src1", 1), (5001, None, "en", "src1", None), (5002, "!! 12", None, None, 5), (5003, "", "en", "src2", 0)]
    bench = [tuple(r) for r in read_table(spark, SF, "benchmark").collect()]
    more += [(5004, base[:200] + " " + bench[0][1].upper() + " " + base[-100:], "en", "src3", 9), start[3]]
    docs = docs.select(*COLUMNS).unionByName(spark.createDataFrame(more, docs.select(*COLUMNS).schema))

    one = stored(p.keep_known_language(spark, docs, SF))
    assert one.columns == COLUMNS
    kept = rows(one)
    assert {5001, 5002, 5003}.isdisjoint(r[0] for r in kept) and len(kept) > 0.97 * len(start)

    two = stored(p.keep_one_of_near_copies(spark, one, SF))
    found = near.brute([(r[0], r[1]) for r in kept], 5, 80, 100)
    assert sorted(r[0] for r in rows(two)) == sorted({x[2] for x in found})
    assert set(rows(two)) <= set(kept) and 5000 not in {r[0] for r in rows(two)}

    three = stored(p.cut_repeated_passages(spark, two, SF))
    assert rows(three) == cut(rows(two))

    four = stored(p.drop_benchmark_leaks(spark, three, SF))
    bad = {d for d, _, _ in leaks.brute([(r[0], r[1]) for r in rows(three)], bench)}
    assert bad and rows(four) == [r for r in rows(three) if r[0] not in bad]

    five = p.mix_sources(spark, four, SF).collect()
    by = {r[0]: r for r in rows(four)}
    sizes, taken, target = {}, {}, {}
    for r in rows(four):
        sizes[r[3]] = sizes.get(r[3], 0) + len(re.findall(r"[^\x20\x09-\x0d]+", r[1] or ""))
    for r in five:
        assert by[r.doc_id] == tuple(r[x] for x in COLUMNS) and 0 < r.taken <= 2 * r["size"] and r.source_size == sizes[r.source]
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    assert abs(sum(target.values()) - 1.5 * sum(sizes.values())) < 1
    largest = max(len((r[1] or "").split()) for r in rows(four))
    assert all(abs(taken[s] - target[s]) <= largest for s in taken)


def test_run_gives_the_stages_in_order(spark):
    assert [n for n, _ in p.STAGES] == ["language_id", "ngram_jaccard_join", "substring_dedup", "benchmark_decontamination", "source_mixing"]
    out = p.run(spark, SF)
    assert set(COLUMNS) < set(out.columns) and 0 < out.count() <= 200


def test_clashing_and_odd_rows(spark):
    docs = read_table(spark, SF, "documents")
    odd = docs.withColumns({x: F.lit(x) for x in ("row", "size", "taken", "body", "rejected", "prefix", "_body", "key", "slice")})
    text = F.when(F.col("doc_id") % 7 == 0, F.repeat(F.concat("text", F.lit(" ")), 300)).when(F.col("doc_id") % 11 == 0, F.lit(None)).otherwise(F.col("text"))
    odd = odd.withColumn("text", text).withColumn("doc_id", F.when(F.col("doc_id") % 13 != 0, F.col("doc_id")))
    for _, stage in p.STAGES[:-1]:
        odd = stored(stage(spark, odd.unionByName(odd.limit(3)), SF))
        assert odd.columns == COLUMNS
    out = p.mix_sources(spark, odd, SF)
    assert 0 < out.count() <= odd.count()


def test_rows_of_one_id_with_other_texts_stay(spark):
    words = [f"{x}{i}" for x in "abc" for i in range(40)]
    one, two, three = " ".join(words[:40]), " ".join(words[40:80]), " ".join(words[80:])
    rows = [(1, one, "en", "s", 1), (1, two, "en", "s", 1), (1, two, "en", "s", 1), (2, two + " more", "en", "s", 1), (None, three, "en", "s", 1), (None, one + " x", "en", "s", 1), (0, three + " y", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in p.keep_one_of_near_copies(spark, docs, SF).collect()), key=str)
    assert got == sorted([(1, one), (1, two), (0, three + " y")], key=str)


def test_without_any_label_all_stay(spark):
    docs = read_table(spark, SF, "documents").withColumn("lang", F.lit(None).cast("string"))
    assert p.keep_known_language(spark, docs, SF).count() == docs.count()


def test_scratch_tables_are_deleted(spark):
    from parlance.llm import _common as c

    before = c.written()
    p.run(spark, SF)
    assert c.written() == before + len(p.STAGES)
    c.clear_stored(spark, before)
    assert c.written() == before


def test_empty_documents(spark):
    docs = read_table(spark, SF, "documents").limit(0)
    for _, stage in p.STAGES:
        docs = stored(stage(spark, docs, SF))
    assert docs.count() == 0


