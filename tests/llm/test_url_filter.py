"""Rules, propagation against a plain walk, defined cases."""
from quarry.llm import url_filter as uf

SCHEMA = "page_id long, url string, html string"


def judged(spark, rows, **kw):
    return {r.page_id: r for r in uf.judge(spark.createDataFrame(rows, SCHEMA), **kw).collect()}


def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[:min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(h + p, v) for h, p, v in uf.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits, key=lambda x: len(x[0])) if fits else (None, None)))


def test_rules(spark):
    urls = ["http://a.com/", "http://a.com", "https://EXAMPLE.com/en/1?x#y", "http://www.example.com/en/2", "http://x.www.example.com/en/3", "http://example.com/en",
            "http://a.net/es/1", "http://a.net/fr/?q=/es/", "http://a.net/de/", "http://net/es/", "http://anet/es/", "http://a.org/en/", None, "", "no scheme.com/",
            "://b.com/x", "http://a.com?/x", "http://a.com#/x", "ftp://user@a.com:80/x", "http://c.com/a\nb?c", "http://first.com/x?u=http://second.net/es/", "http:///x",
            "http://É.com/x"]
    got = judged(spark, [(i, u, None) for i, u in enumerate(urls)])
    for i, u in enumerate(urls):
        host, path, rule, verdict = plain_rule(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        if verdict:
            assert got[i].verdict == verdict, u
    assert all(got[i].verdict == "allow" for i, u in enumerate(urls) if not plain_rule(u)[0])


def walk(edges, seeds, damping=uf.DAMPING, rounds=uf.ROUNDS):
    total = {}
    for (a, _), w in edges.items():
        total[a] = total.get(a, 0) + w
    mass = dict(seeds)
    for _ in range(rounds):
        new = {h: (1 - damping) * m for h, m in seeds.items()}
        for (a, b), w in edges.items():
            if mass.get(a):
                new[b] = new.get(b, 0) + damping * mass[a] * w / total[a]
        mass = new
    return mass


def test_links_spread_trust_and_distrust(spark):
    link = lambda *hosts: "".join(f'<a href="https://{h}/x">x</a><a href="/local">y</a>' for h in hosts)
    rows = [(1, "http://good.com/1", link("Friend.org", "friend.org")), (2, "http://friend.org/1", link("far.io")), (3, "http://bad.net/es/1", None),
            (4, "http://shady.org/1", link("bad.net")), (5, "http://far.io/", ""), (6, "http://alone.info/", "<a href='mailto:x'>"),
            (7, "http://bad.net/de/", link("bad.net")), (8, "http://good.com/2", "<A HREF=//friend.org/z>")]
    got = judged(spark, rows)
    assert {i: got[i].verdict for i in got} == {1: "allow", 2: "allow", 3: "block", 4: "block", 5: "allow", 6: "allow", 7: "block", 8: "allow"}
    # the table of edges: "Friend.org" and "friend.org" of page 1 are two strings of one host
    edges = {("good.com", "friend.org"): 3.0, ("friend.org", "far.io"): 1.0, ("shady.org", "bad.net"): 1.0}
    trust = walk(edges, {"good.com": 1.0})
    distrust = walk({(b, a): w for (a, b), w in edges.items()}, {"bad.net": 1.0})
    for r in got.values():
        assert abs((r.trust or 0) - trust.get(r.host, 0)) < 1e-9 and abs((r.distrust or 0) - distrust.get(r.host, 0)) < 1e-9


def test_names_of_hosts_are_edges(spark):
    got = judged(spark, [(1, "http://a.b.site.org/x", None), (2, "http://site.org/x", None), (3, "http://c.site.org/bad", None)],
                 rules=(("c.site.org", "/bad", "block"),))
    assert {got[i].verdict for i in got} == {"block"}


def test_repeats_empty_and_clashing_names(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(1, "http://x.org/", None), (1, "http://x.org/", None), (None, None, None)], SCHEMA)
    df = df.withColumn("host", F.lit("h")).withColumn("rule", F.lit(1)).withColumn("src", F.lit("s")).withColumn("kind", F.lit("k"))
    got = uf.judge(df).collect()
    assert sorted((str(r.page_id), r.host, r.verdict) for r in got) == [("1", "x.org", "allow"), ("1", "x.org", "allow"), ("None", "", "allow")]
    assert uf.judge(df.limit(0)).collect() == []


def test_few_blocked_pages_or_one_blocked_sibling_do_not_condemn(spark):
    rows = [(i, f"http://big.net/{'es' if i < 2 else 'de'}/{i}", None) for i in range(10)]                       # 2 of 10 pages blocked
    rows += [(20 + i, f"http://bad.net/{'es' if i < 8 else 'de'}/{i}", None) for i in range(10)]                # 8 of 10
    rows += [(40 + i, f"http://h{i}.shared.net/{'fr' if i == 0 else 'de'}/x", None) for i in range(20)]        # one host of 20 under a parent
    rows += [(90, "http://h0.shared.net/de/", None)]
    got = judged(spark, rows)
    assert {i for i in got if got[i].verdict == "block"} == {0, 1, *range(20, 30), 40, 90}
