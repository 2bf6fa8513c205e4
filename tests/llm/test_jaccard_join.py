import random
import re

import pytest

from parlance.llm import jaccard_join as m
from parlance.llm.components import components

SCHEMA = "doc_id long, text string, node int, n int"


def shingles(t, k):
    t = re.sub("[A-Z]", lambda x: x[0].lower(), t or "")
    w = re.findall(r"[^\x20\x09-\x0d]+", t)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def brute(rows, k=3, num=90, den=100):
    sets = [shingles(r[1], k) for r in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    best = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            best[top(i)] = min(r[0], best.get(top(i), r[0]))
    return sorted(((r[0], len(s), best.get(top(i))) for i, (r, s) in enumerate(zip(rows, sets))), key=str)


def fixture():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 4)))
    words = lambda n: [word() for _ in range(n)]
    docs = []
    for n in (4, 8, 12, 14, 20, 21, 25, 31, 60, 150, 400):
        base = words(n)
        docs += [base, base]
        for _ in range(12):
            x = list(base)
            for _ in range(r.randint(1, 1 + n // 40)):
                at = r.randrange(len(x))
                r.choice([lambda: x.pop(at), lambda: x.insert(at, word()), lambda: x.__setitem__(at, word()), lambda: x.append(word())])()
            docs.append(x)
    line = words(9)
    docs += [line + words(r.randint(1, 30)) for _ in range(90)] + [words(1), words(2), [], ["A", "b"], ["a", "B"]]
    rows = [(i, " ".join(d), 1, 1) for i, d in enumerate(docs)]
    r.shuffle(rows)
    return [*rows, (500, None, None, None), (501, " \n", 1, 1), rows[5], (None, rows[9][1], 1, 1), (None, "only null", 1, 1), (None, None, 1, 1)]


def got(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id").collect()), key=str)


@pytest.mark.parametrize("how", [{}, {"num": 80, "shingle": 2, "tile": 8, "wide": 16, "common": 5}, {"boundary": 19, "tile": 4, "wide": 8}, {"boundary": 0, "common": 0}])
def test_matches_brute_force(spark, how):
    rows = fixture()
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(m.similar_sets(df, **how)) == brute(rows, how.get("shingle", 3), how.get("num", 90))


def test_a_group_of_unlinked_near_copies_costs_few_rows(spark, monkeypatch):
    """Copies of a text that isn't there itself: their long lists merge, and candidate rows stay near the number of copies."""
    r = random.Random(8)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for i in range(600):
        x = list(base)
        for at in r.sample(range(100), 4):
            x[at] = f"x{i}_{at}"
        rows.append((i, " ".join(x), 1, 1))
    made = []
    for name in ("_forests", "_between_components"):
        plain = getattr(m, name)
        monkeypatch.setattr(m, name, lambda *a, plain=plain: made.append(plain(*a)) or made[-1])
    places = []
    compared = m._compared
    monkeypatch.setattr(m, "_compared", lambda df, *a, **b: places.append(df.count()) or compared(df, *a, **b))
    found = m.similar_sets(spark.createDataFrame(rows, SCHEMA), tile=64, wide=1024)
    assert got(found) == brute(rows)
    assert len(places) == 2 and max(places) < 12 * len(rows)
    assert sum(x.count() for x in made) < 12 * len(rows)


@pytest.mark.parametrize("words", [1, 60_000])
def test_very_long_texts(spark, words):
    base = [f"w{i}" for i in range(words)]
    rows = [(1, " ".join(base), 1, 1), (2, " ".join(base[: -words // 50] + ["end"]), 1, 1), (3, " ".join(base[::-1]), 1, 1), (3, " ".join(base[::-1]), 1, 1)]
    assert got(m.similar_sets(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


@pytest.mark.parametrize("k, num, n, boundary", [(3, 90, 9, 19), (3, 90, 9, 11), (5, 80, 4, 10), (5, 80, 4, 6)])
def test_small_set_within_a_larger_one(spark, k, num, n, boundary):
    words = [f"w{i}" for i in range(n + k)]
    rows = [(1, " ".join(words[:-1]), 1, 1), (2, " ".join(words), 1, 1), (3, " ".join(words[:-2]), 1, 1), (4, "other words", 1, 1)]
    found = got(m.similar_sets(spark.createDataFrame(rows, SCHEMA), shingle=k, num=num, boundary=boundary))
    assert found == brute(rows, k, num)
    assert dict((r[0], r[2]) for r in found)[2] == 1


def test_empty_table(spark):
    assert m.similar_sets(spark.createDataFrame([], SCHEMA)).count() == 0


def test_boundary_follows_cost():
    assert m.boundary_by_cost([(10, 100, 10), (15, 100, 10)], 90, 100) == 0
    assert m.boundary_by_cost([(10, 100, 90_000), (15, 100, 90_000), (35, 1, 10**9)], 90, 100) == 15


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (100, 200), (7, 7), (300, 300)]
    rows = {tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert rows == {(i, 0) for i in range(61)} | {(100, 100), (101, 100), (200, 100)}


def test_only_shared_keys_and_no_sketches_are_sent_on(spark, monkeypatch):
    stored, second = [], []

    def store(df, stored_=m.c.stored):
        stored.append(stored_(df))
        return stored[-1]

    def between(members, *more, between_=m._between_components):
        second.append(members.columns)
        return between_(members, *more)

    monkeypatch.setattr(m.c, "stored", store)
    monkeypatch.setattr(m, "_between_components", between)
    near = " ".join(f"w{i}" for i in range(40))
    rows = [(i, f"{near} x{i}") for i in range(12)] + [(100 + i, " ".join(f"u{i}_{j}" for j in range(40))) for i in range(30)]
    out = m.similar_sets(spark.createDataFrame(rows, "doc_id long, text string"), tile=4)
    assert {r.doc_id: r.component_id for r in out.collect()} == {i: 0 if i < 12 else i for i, _ in rows}
    postings = [x for x in stored if x.columns == ["key", "row"]]
    assert postings and all(x.groupBy("key").count().filter("count < 2").count() == 0 for x in postings[:1])
    assert second and not any("sketch" in x for x in second)
