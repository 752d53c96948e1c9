import re

from eventide.llm import urls as U
from eventide.llm.queries import URL_RULES


def judged(spark, urls, outcomes=(), **kw):
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, n int")
    out = spark.createDataFrame(list(outcomes), "id long, bad int")
    return {r.page_id: r for r in U.judge(pages, out, kw.pop("rules", URL_RULES), **kw).collect()}


def test_parts_and_rules(spark):
    urls = ["http://Ex.COM/fr/a?b#c", "x", None, "", "http://a.b.example.org:80/en/12", "https://org/", "https://org", "http://notexample.org/es/",
            "http://example.org/es/", "ftp://u:p@www.com/de/?x", "a://b://c/d", "http://É.com?x=/de/", "http://example.org/en/1"]
    got = judged(spark, urls)
    parts = {}
    for i, u in enumerate(urls):
        rest = (u or "").split("://", 1)[1] if u and "://" in u else ""
        h = re.split(r"[/?#]", rest, maxsplit=1)[0]
        parts[i] = ("".join(c.lower() if c.isascii() else c for c in h), re.split(r"[?#]", rest[len(h):], maxsplit=1)[0])
    assert {i: (r.host, r.path) for i, r in got.items()} == parts
    rules = [got[i].rule for i in range(len(urls))]
    assert rules == ["com/fr/", None, None, None, None, "org/", None, "org/", "example.org/es/", "com/de/", None, None, "example.org/en/1"]
    assert [got[i].verdict for i in (0, 1, 4, 5, 8, 9)] == ["allow", "allow", "allow", "allow", "block", "block"]


def test_shrinkage(spark):
    urls, out, i = [], [], 0
    for host, n, bad in (("bad.site.net", 60, 58), ("www.good.net", 60, 1), ("few.good.net", 2, 2), ("new.good.net", 3, None), ("n.site.net", 2, None)):
        for k in range(n):
            urls.append(f"http://{host}/{k}")
            if bad is not None:
                out += [(i, int(k < bad)), (i, 0)]  # a repeated outcome changes nothing
            i += 1
    got = judged(spark, urls + ["http://bad.site.net/fr"], out + [(None, 1), (5, None)], rules=())
    verdict = {}
    for k, u in enumerate(urls):
        verdict.setdefault(U_host(u), set()).add(got[k].verdict)
    assert verdict == {"bad.site.net": {"block"}, "www.good.net": {"allow"}, "few.good.net": {"allow"}, "new.good.net": {"allow"}, "n.site.net": verdict["n.site.net"]}
    assert got[len(urls)].verdict == "block"


def U_host(u):
    return u.split("/")[2]


def test_nothing(spark):
    assert judged(spark, []) == {}
    assert judged(spark, ["http://a.b/"], [])[0].verdict == "allow"
    same = judged(spark, ["http://a.b/1", "http://a.b/2"], [(0, 1), (1, 1)], rules=())
    assert {r.verdict for r in same.values()} == {"block"} or {r.verdict for r in same.values()} == {"allow"}


def test_half_known_labels_count(spark):
    rows = [(1, 0, None), (2, None, 1), (3, 1, None), (4, None, 0), (5, None, None), (6, 0, 1), (7, 1, 0)]
    got = U.outcomes(spark.createDataFrame(rows, "doc_id long, quality int, toxic int")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 1), (2, 1), (3, 0), (4, 0), (6, 1), (7, 0)]
