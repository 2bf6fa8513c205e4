import re
from collections import Counter, defaultdict

from parlance.llm import url_filter as m
from parlance.llm._common import read_table

SCHEMA = "page_id long, url string, host string, n int"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    return re.sub("[A-Z]", lambda x: x[0].lower(), host), path


def ruled(host, path, rules):
    best = None
    for kind, text in rules:
        d, _, p = text.partition("/")
        if (host == d or host.endswith("." + d)) and path.startswith("/" + p) and (best is None or len(text) > len(best[1])):
            best = kind, text
    return best or (None, None)


def brute(rows, rules=m.RULES):
    pages = [(r[0], *parts(r[1])) for r in rows]
    label = {(h, p): ruled(h, p, rules) for _, h, p in pages}
    n = Counter((h, p) for _, h, p in pages)
    blocked = {k: c * (label[k][0] == "block") for k, c in n.items()}
    labelled = {k: c * (label[k][0] is not None) for k, c in n.items()}
    template, open_ = {k: "" for k in n}, {k: (k[1][1:] if k[1].startswith("/") else k[1]).split("/", m.DEPTH - 1) for k in n}
    while open_:
        below = defaultdict(lambda: defaultdict(lambda: [0, 0, 0]))
        for k, rest in open_.items():
            for i, x in enumerate((1, blocked[k], labelled[k])):
                below[k[0], template[k]][rest[0]][i] += x
        part = {}
        for parent, kids in below.items():
            varied = len(kids) >= m.LEAST and len(kids) >= m.VARIED * sum(x[0] for x in kids.values())
            rates = Counter()
            rare = [l for paths, _, l in kids.values() if varied and paths < m.LEAST]
            known = sum(l > 0 for l in rare)
            spread = known >= m.LEAST and known >= m.VARIED * len(rare)
            for seg, (paths, b, l) in kids.items():
                if varied and paths < m.LEAST and (spread or not l):
                    part[parent, seg] = "*"
                elif not l:
                    part[parent, seg] = "*0"
                else:
                    rates[b / l, b, l] += 1
            group, last, groups = 0, None, {}
            for rate, b, l in sorted(rates):
                B, L = b * rates[rate, b, l], l * rates[rate, b, l]
                if last is not None:
                    pool = (B + last[0]) / (L + last[1])
                    var = pool * (1 - pool) * (1 / L + 1 / last[1])
                if last is None or (var and (B / L - last[0] / last[1]) ** 2 / var >= m.Z**2):
                    group += 1
                last, groups[b, l] = (B, L), group
            size = Counter()
            for (_, b, l), x in rates.items():
                size[groups[b, l]] += x
            for seg, (_, b, l) in kids.items():
                if (parent, seg) not in part:
                    g = groups[b, l]
                    part[parent, seg] = f"={seg}" if size[g] == 1 else f"*{g}"
        for k, rest in open_.items():
            template[k] += "/" + part[(k[0], template[k]), rest[0]]
        open_ = {k: rest[1:] for k, rest in open_.items() if len(rest) > 1}
    sums = defaultdict(lambda: [0, 0])
    for k in n:
        sums[k[0], template[k]][0] += blocked[k]
        sums[k[0], template[k]][1] += labelled[k]
    out = []
    for i, h, p in pages:
        b, l = sums[h, template[h, p]]
        kind, text = label[h, p]
        out.append((i, h, p, text, kind or ("block" if (b + 1) / (l + 2) >= m.REJECT else "allow"), template[h, p]))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.select("page_id", "host", "path", "rule", "verdict", "template").collect()), key=str)


def test_matches_brute_force(spark):
    urls = [f"https://A.Example.com/{'en' if i % 3 else 'fr'}/{i % 90}?x={i}" for i in range(300)]
    urls += [f"http://b.example.net/{('de', 'en', 'x/y/z')[i % 3]}/{i}" for i in range(60)]
    urls += ["http://com/en/", "http://xcom/en/1", "ftp://q.example.com/en/7/1", "http://h", "http://h?/a", "http://h#://x/y", "no url", "", None, "a://b://c/d", "http://É.org/es/1", "http://h/a//b/", "http://h/a\n/b"]
    rows = [(i, u, "x", 1) for i, u in enumerate(urls)] + [(3, urls[3], "x", 1), (None, urls[9], None, None)]
    assert got(m.judged(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    spam = tuple([*m.RULES, ("block", "spam.org/")])
    rows = [(i, f"http://{'spam.org' if i % 2 else 'ok.org'}/a/{i}", "", 0) for i in range(50)]
    assert got(m.judged(spark.createDataFrame(rows, SCHEMA), spam)) == brute(rows, spam)


def test_clean_sections_of_small_hosts_stay(spark):
    urls = [f"http://a.example.org/{x}/{i}" for x in ("es", "fr", "de", "*") for i in range(4)]
    urls += ["http://deep.org/" + "x/" * 5000]
    found = {r[2]: r for r in got(m.judged(spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(urls)], SCHEMA)))}
    assert all((r[4] == "block") == path.startswith("/es/") for path, r in found.items())
    assert found["/fr/1"][5] == found["/*/1"][5] != found["/es/1"][5]


def test_rare_clean_sections_beside_a_blocked_one_stay(spark):
    urls = [f"http://a.example.com/en/{i}" for i in range(4)] + [f"http://a.example.com/{x}/1" for x in ("fr", "de", "it", "pt", "nl")]
    found = {r[2]: r[4] for r in got(m.judged(spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(urls)], SCHEMA)))}
    assert {path: verdict == "block" for path, verdict in found.items()} == {path: path.startswith("/en/") for path in found}


def test_labels_spread_over_a_variable_segment_judge_its_other_values(spark):
    rules = tuple(("block", f"h.com/u/{i}") for i in range(100, 130)) + (("allow", "h.com/u/99"),)
    urls = [f"http://h.com/u/{i}/p" for i in range(95, 140)] + [f"http://h.com/about/{i}" for i in range(30)]
    found = {r[2]: (r[3], r[4]) for r in got(m.judged(spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(urls)], SCHEMA), rules))}
    assert all(found[f"/u/{i}/p"] == (None, "block") for i in (95, 135, 139)) and found["/u/99/p"][1] == "allow"
    assert all(found[f"/about/{i}"] == (None, "allow") for i in range(30))


def test_similar_branches_merge(spark):
    rules = tuple(("block", f"h.com/{x}/b") for x in "pq") + (("allow", "h.com/r/a"), ("allow", "h.com/p/a"), ("allow", "h.com/q/a"))
    urls = [f"http://h.com/{x}/{y}{i}" for x in "pqr" for y in "ab" for i in range(30)]
    found = {r[2]: r for r in got(m.judged(spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(urls)], SCHEMA), rules))}
    assert found["/p/a1"][5].split("/")[1] == found["/q/a1"][5].split("/")[1] == "*2"
    assert found["/r/a1"][5].split("/")[1] == "=r"


def test_rules_are_those_of_the_contract(spark):
    words = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    urls = [f"http://{h}/{p}" for h in ("a.com", "example.com", "a.net", "b.example.net", "a.org") for p in ("en/1", "en/71", "de/1", "de/81", "es/1")]
    found = {(r[1], r[2]): (r[3], r[4]) for r in got(m.judged(spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(urls)], SCHEMA)))}
    assert {rule: verdict for rule, verdict in found.values() if rule} == words
    assert found["a.net", "/de/81"] == ("net/de/", "allow") and found["b.example.net", "/de/81"] == ("example.net/de/8", "block")


def test_empty_table(spark):
    assert m.judged(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.page_id, r.url) for r in read_table(spark, sf, "pages").select("page_id", "url").collect()]
    assert got(m.op7_url_filter(spark, sf)) == brute(rows)
