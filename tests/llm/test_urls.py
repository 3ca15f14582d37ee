from collections import defaultdict

from civiclens.llm.link_graph import DAMPING, ROUNDS, THRESHOLD, Rule, judge_urls
from civiclens.llm.queries import URL_RULES

PAGES = [
    (1, "http://Good.org/fr/a?x#y", '<a href="http://friend.info/x">f</a>'),
    (2, "http://bad.net", '<a href="//friend.info">'),
    (3, "http://bad.net/", None),
    (4, "https://links.info/p", "<a class=q href='http://bad.net/1'><A HREF=http://BAD.net/2>"),
    (5, "https://friend.info/p?u=http://bad.net/", "<p>"),
    (6, "nothing", "<a href='/rel'>"),
    (7, None, "<p>"),
    (8, "x://a.example.net/en/1", ""),
    (9, "x://example.net.evil/en/1", ""),
    (10, "x://sub.a.example.com/de/", ""),
    (11, "x://example.com/dee", ""),
    (11, "x://example.com/dee", ""),
    (None, "http://org", ""),
]
SCHEMA = "page_id long, url string, html string, host string, dst string"


def frame(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


def test_rules_hosts_and_paths(spark):
    rows = judge_urls(frame(spark), URL_RULES).collect()
    got = {r.page_id: r for r in rows}
    assert len(rows) == len(PAGES)
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("good.org", "/fr/a", "org/fr/", "allow")
    assert (got[2].path, got[2].rule) == ("", None)
    assert (got[3].rule, got[3].verdict) == ("net/", "block")
    assert (got[6].host, got[6].path, got[6].verdict, got[7].host) == ("", "", "allow", "")
    assert got[8].rule == "example.net/en/" and got[9].rule is None and got[10].rule == "example.com/de/" and got[11].rule is None
    assert (got[None].host, got[None].rule) == ("org", None)
    assert judge_urls(frame(spark).limit(0), URL_RULES).count() == 0


def test_propagation_equals_brute_force(spark):
    pages = [(i, f"http://h{i % 9}.info/p{i}", "".join(f"<a href='http://h{(i * k) % 9}.info/'>" for k in (2, 5))) for i in range(60)]
    pages += [(100 + i, f"http://seed{i}.net/", f"<a href='http://h{i}.info/'>") for i in range(3)]
    pages += [(200 + i, f"http://spam{i}.info/", f"<a href='http://seed{i}.net/'>") for i in range(3)]
    pages += [(300, "http://ok.org/", "<a href='http://h1.info'>")]
    rules = [Rule("net", "/", "block"), Rule("org", "/", "allow")]
    weight, count, allowed, blocked = defaultdict(float), defaultdict(int), defaultdict(int), defaultdict(int)
    host = lambda u: u.split("://")[1].split("/")[0]
    import re

    for _, url, html in pages:
        h = host(url)
        count[h] += 1
        allowed[h] += h.endswith(".org")
        blocked[h] += h.endswith(".net")
        for to in re.findall(r"href='http://([^/']+)", html):
            if to != h:
                weight[h, to] += 1
    out, into = defaultdict(float), defaultdict(float)
    for (a, b), w in weight.items():
        out[a] += w
        into[b] += w
    na, nb = sum(allowed.values()), sum(blocked.values())
    nodes = {*count, *(x for e in weight for x in e)}
    seeds = {h: (allowed[h] / na, blocked[h] / nb) for h in nodes}
    rank = dict(seeds)
    for _ in range(ROUNDS):
        new = {h: [(1 - DAMPING) * s for s in seeds[h]] for h in nodes}
        for (a, b), w in weight.items():
            new[b][0] += DAMPING * rank[a][0] * w / out[a]
            new[a][1] += DAMPING * rank[b][1] * w / into[b]
        rank = new
    bad = {h for h in count if (rank[h][1] * nb - rank[h][0] * na) / (1 - DAMPING) / count[h] >= THRESHOLD}
    got = {r.page_id: r.verdict for r in judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), rules).collect()}
    for i, url, _ in pages:
        h = host(url)
        want = "block" if h.endswith(".net") else "allow" if h.endswith(".org") else "block" if h in bad else "allow"
        assert got[i] == want, url
    assert bad  # a host that links to blocked ones is caught


def test_distrust_goes_along_chains_of_any_length(spark):
    # d links from a blocked host of n pages, n * DAMPING^d arrives
    pages, want = [], {}
    for name, n, long in (("one", 1, 10), ("ten", 10, 22)):
        pages += [(len(pages) + i, f"http://{name}.net/{i}", "") for i in range(n)]
        for d in range(1, long + 1):
            to = f"{name}{d - 1}.info" if d > 1 else f"{name}.net"
            pages.append((len(pages), f"http://{name}{d}.info/", f"<a href='http://{to}/'>"))
            want[len(pages) - 1] = "block" if n * DAMPING**d >= THRESHOLD else "allow"
    got = {r.page_id: r.verdict for r in judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), [Rule("net", "/", "block")]).collect()}
    assert {i: got[i] for i in want} == want and set(want.values()) == {"allow", "block"}
