"""URL filter against a plain-Python walk over the same graph."""

import re
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from recordlens.llm import oracle, url_filters
from recordlens.llm.queries import URL_RULES, op1_url_filters

SCHEMA = "page_id long, url string, html string, host int"


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    at = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:at])
    return host, re.split(r"[?#]", rest[at:], maxsplit=1)[0]


def rule_for(host, path, rules):
    best = None
    for verdict, rule in rules:
        domain, slash, rest = rule.partition("/")
        if (host == domain or host.endswith("." + domain)) and path.startswith(slash + rest):
            if best is None or len(rule) > len(best[1]):
                best = (verdict, rule)
    return best


def scores(pages, rules, damping=0.85):
    """Trust and distrust per host, walked until nothing changes."""
    count, by_rule, links = Counter(), Counter(), Counter()
    for _, url, html in pages:
        host, path = split_url(url)
        if not host:
            continue
        count[host] += 1
        rule = rule_for(host, path, rules)
        if rule:
            by_rule[host, rule[0]] += 1
        for link in re.findall(r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)""", html or ""):
            m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", link)
            if m and m[1] and m[1].lower() != host:
                links[host, m[1].lower()] += 1
    out = Counter()
    for (a, _), n in links.items():
        out[a] += n
    hosts = set(count) | {h for pair in links for h in pair}
    good, bad = ({h: by_rule[h, v] / count[h] if count[h] else 0.0 for h in hosts} for v in ("allow", "block"))
    t, d = dict(good), dict(bad)
    for _ in range(200):
        nt, came = dict(good), Counter()
        for (a, b), n in links.items():
            nt[b] += damping * t[a] * n / out[a]
            came[a] += d[b] * n / out[a]
        t, d = nt, {h: bad[h] + (1 - bad[h]) * damping * came[h] for h in hosts}
    return t, d


def brute(pages, rules, threshold=0.5):
    parsed = [(i, *split_url(u), h) for i, u, h in pages]
    found = [rule_for(host, path, rules) for _, host, path, _ in parsed]
    t, d = scores(pages, rules)
    bad = {h for h in d if d[h] > threshold and d[h] > t[h] + url_filters.MARGIN}
    return sorted(
        (
            (i, host, path, rule[1] if rule else None, rule[0] if rule else ("block" if host in bad else "allow"))
            for (i, host, path, _), rule in zip(parsed, found)
        ),
        key=repr,
    )


def rows(df):
    return sorted((tuple(r) for r in df.select("page_id", "host", "path", "rule", "verdict").collect()), key=repr)


def test_whole_table_equals_brute_force(spark, tables):
    pages = spark.read.parquet(f"{tables}/pages.parquet").select("page_id", "url", "html").collect()
    assert rows(op1_url_filters(spark, tables)) == brute([tuple(p) for p in pages], URL_RULES)


def test_links_carry_trust_and_distrust(spark):
    def links(*hosts):
        return "".join(f'<a HREF="https://{h}/x">' for h in hosts)

    pages = [
        (1, "http://bad.net/a", links("bad.net")),
        (2, "http://friend.com/a", links("bad.net", "bad.net", "friend.com")),
        (3, "http://far.com/", links("friend.com")),
        (4, "http://x.org/fr/1", links("liked.com")),
        (5, "http://liked.com/", '<a href="/own"><a href=//bad.net/>'),
        (6, None, None),
        (7, "no scheme", "<a href='https://bad.net'>"),
        (8, "HTTP://UPPER.NET?x=/y#z", ""),
        (9, "https://friend.com/a", None),
        (9, "https://friend.com/a", None),
        (None, "https://a.example.COM/de/x", ""),
        (10, "https://example.net/en/", ""),
        (11, "https://notexample.net/en/", ""),
        (12, "x://y://z/", ""),
    ]
    df = spark.createDataFrame([(*p, 1) for p in pages], SCHEMA).select("page_id", "url", "html")
    got = rows(url_filters.filter_urls(df, URL_RULES))
    assert got == brute(pages, URL_RULES)
    verdicts = {r[0]: r[4] for r in got}
    assert verdicts[2] == "block" and verdicts[5] == "allow" and verdicts[6] == "allow"


def graph_of_a_farm():
    """A blocked hub with 200 linkers, hosts that link to these, a cycle of honest hosts with one bad link."""
    def page(i, host, *links):
        return (i, f"https://{host}/p", '<a href="/own">' * 9 + "".join(f"<a href='//{h}/'>" for h in links))

    farm = [page(i, f"farm{i}.com", "hub.net") for i in range(200)]
    second = [page(200 + i, f"second{i}.com", *[f"farm{k}.com" for k in range(i, i + 20)]) for i in range(5)]
    honest = [page(300 + i, f"h{i}.com", *[f"h{(i + k) % 30}.com" for k in range(1, 20)], "hub.net") for i in range(30)]
    half = [(400, "https://example.com/de/", ""), (401, "https://example.com/en/", ""), page(402, "near.com", "example.com")]
    return [(500, "https://hub.net/", ""), *farm, *second, *honest, *half, page(403, "x.org", "h0.com")]


def test_a_farm_is_blocked_and_one_bad_link_is_not(spark, monkeypatch):
    monkeypatch.setattr(url_filters, "LINKS_A_PIECE", 30)  # so that the hub is cut
    pages = graph_of_a_farm()
    df = spark.createDataFrame([(*p, 1) for p in pages], SCHEMA).select("page_id", "url", "html")
    got = rows(url_filters.filter_urls(df, URL_RULES))
    assert got == brute(pages, URL_RULES)
    blocked = {r[0] for r in got if r[4] == "block"}
    assert blocked == {*range(205), 400, 500}


def test_scores_equal_a_plain_walk(spark):
    pages = graph_of_a_farm()
    df = spark.createDataFrame([(*p, 1) for p in pages], SCHEMA)
    parsed = df.select(url_filters.host_of(F.col("url")).alias("host"), url_filters.path_of(F.col("url")).alias("path"), "html")
    judged = parsed.withColumn("found", url_filters.rule_of(F.col("host"), F.col("path"), URL_RULES))
    found = url_filters.host_scores(url_filters.host_seeds(judged), url_filters.host_links(parsed)).collect()
    t, d = scores(pages, URL_RULES)
    assert {r.host for r in found} == set(d)
    assert all(abs(r.trust - t[r.host]) < 1e-4 and abs(r.distrust - d[r.host]) < 1e-4 for r in found)


def test_sql_walks_a_linked_graph(spark):
    pages = graph_of_a_farm()
    base = duckdb.connect()
    base.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    base.executemany("INSERT INTO pages VALUES (?, ?, ?)", pages)
    got = base.execute(f"SELECT page_id, host, path, rule, verdict FROM ({oracle.sql(URL_RULES)['op1_url_filters']})").fetchall()
    assert sorted(got, key=repr) == brute(pages, URL_RULES)


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert url_filters.filter_urls(empty, URL_RULES).count() == 0
    one = spark.createDataFrame([(1, "http://a.net/", "", 7)], SCHEMA)
    assert rows(url_filters.filter_urls(one, URL_RULES)) == [(1, "a.net", "/", "net/", "block")]
