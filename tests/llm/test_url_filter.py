import random

from corpusgauge.llm import url_filter
from corpusgauge.llm.queries import URL_RULES

RULES = "verdict string, host string, path string"


def plain(url, rules):
    """Host, path, rule and verdict by trying every rule."""
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:]
        path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def urls():
    rng = random.Random(4)
    hosts = ["example.net", "www.Example.NET", "a.b.example.com", "example.com", "x.org", "org", "net", "notnet", "n.et", "éx.net", ""]
    paths = ["", "/", "/en", "/en/", "/en/x", "/de/1?q=/fr/", "/fr/#top", "?x", "#y", "/EN/", "/en//z://net/"]
    made = [f"http://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(400)]
    return made + [None, "", "no scheme", "://", "http://", "http://net", "a://b://net/", "http://net/\nx"]


def judged(spark, rules, made):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(made)], "page_id long, url string, rule string")
    frame = spark.createDataFrame(rules, RULES)
    rows = url_filter.judge(pages.repartition(3), frame).collect()
    assert len(rows) == len(made)
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}


def test_rules_of_the_query(spark):
    made = urls()
    assert judged(spark, list(URL_RULES), made) == {i: plain(u, URL_RULES) for i, u in enumerate(made)}


def test_many_rules_need_several_levels(spark):
    rng = random.Random(9)
    rules = sorted({(rng.choice(["block", "allow"]), f"h{i}.com", rng.choice(["/", "/a/"])) for i in range(0, 600, 2)})
    made = [f"https://www.h{i}.com/{rng.choice(['a/b', 'b'])}" for i in range(600)]
    assert judged(spark, rules, made) == {i: plain(u, rules) for i, u in enumerate(made)}
    listed = spark.createDataFrame([(h + p,) for _, h, p in rules], "key string")
    universe = spark.createDataFrame([(f"h{i}.com{p}",) for i in range(600) for p in ("/", "/a/")], "key string")
    levels = url_filter.build_cascade(listed, universe)
    assert len(levels) > 1
    inside = {h + p for _, h, p in rules}
    assert all(url_filter.is_listed(levels, f"h{i}.com{p}") == (f"h{i}.com{p}" in inside) for i in range(600) for p in ("/", "/a/"))


def test_join_beyond_the_bound_gives_equal_rows(spark, monkeypatch):
    made = urls()
    expected = judged(spark, list(URL_RULES), made)
    monkeypatch.setattr(url_filter, "MAX_BYTES", 0)
    assert judged(spark, list(URL_RULES), made) == expected


def test_no_rules_and_no_pages(spark):
    assert set(v for *_, v in judged(spark, [("allow", None, "/")], urls()).values()) == {"allow"}
    assert judged(spark, list(URL_RULES), []) == {}
