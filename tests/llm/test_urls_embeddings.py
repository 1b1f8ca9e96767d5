"""URL filter and embedding links, against SQL and brute force."""

import math

import numpy as np
import pytest
from corpus_helpers import counted

from stayline.llm.embeddings import link_vectors, tables_for
from stayline.llm.queries import URL_RULES
from stayline.llm.urls import judge_urls

PAGES = "page_id long, url string, html string, host string, n string, kind string"


def link(*hosts):
    return " ".join(f'<A HREF="https://{h}/x">t</A> <a href="/local">l</a>' for h in hosts)


def pages(spark, *rows):
    return spark.createDataFrame([(*r, "x", "x", "x") for r in rows], PAGES)


def page_rows():
    return [
        (1, "http://a.example.com/en/1", link("good.org", "WWW.good.org")),
        (2, "https://www.example.com/en/2?x=/es/", link("good.org")),
        (3, "HTTP://Shop.NET/es/1#top", link("bad.org", "good.org")),
        (4, "http://shop.net/de/1", None),
        (5, "http://farm.org/", link("shop.net", "shop.net")),
        (6, "http://farm2.org/p", link("farm.org", "shop.net")),
        (7, "http://good.org/", link("better.org")),
        (8, "http://better.org", ""),
        (9, "http://bad.org/y", link("nowhere.io")),
        (10, None, link("good.org")),
        (11, "no host here", link("good.org")),
        (12, "http://", "x"),
        (13, "ftp://com/x", ""),
        (14, "http://notexample.com/en/", ""),
        (15, "http://x.com?a", link("shop.net")),
        (15, "http://x.com?a", link("shop.net")),
        (16, "http://ÄB.com/en/x://y", "href=http://good.org"),
        (None, "http://shop.net/fr/", None),
    ]


def test_verdicts_are_those_of_the_sql(spark, by_sql):
    df = pages(spark, *page_rows())
    found = judge_urls(df, URL_RULES)
    assert counted(found.select("page_id", "host", "path", "rule", "verdict")) == by_sql("op1_urls", pages=df)


def test_distrust_runs_against_the_links_and_trust_along_them(spark):
    rows = {r.page_id: r for r in judge_urls(pages(spark, *page_rows()), URL_RULES).collect()}
    assert rows[4].verdict == "block" and rows[4].rule is None
    assert rows[5].verdict == "block" and rows[6].verdict == "block"  # they link to shop.net
    assert rows[7].verdict == rows[8].verdict == rows[9].verdict == "allow"
    assert rows[7].trust > rows[8].trust > 0 == rows[9].distrust
    assert (rows[10].host, rows[10].path, rows[10].verdict) == ("", "", "allow")
    assert (rows[1].rule, rows[2].rule) == ("example.com/en/", "www.example.com/en/")


def test_ranks_of_trust_sum_to_one_where_nothing_ends(spark):
    ring = [(k, f"http://h{k}.com/", link(f"h{(k + 1) % 4}.com")) for k in range(4)]
    rows = judge_urls(pages(spark, *ring), URL_RULES).collect()
    assert sum(r.trust for r in rows) == pytest.approx(1)


def test_no_pages(spark):
    assert judge_urls(pages(spark), URL_RULES).collect() == []


VECTORS = "vec_id long, embedding array<float>, label int, rep string, n string, key string, vector string, weight string"


def vectors(spark, *rows):
    return spark.createDataFrame([(i, v, 0, *["x"] * 5) for i, v in rows], VECTORS)


def vector_rows():
    random = np.random.default_rng(5)
    rows = []
    for group in range(6):
        centre = random.standard_normal(48)
        for _ in range(5 + 6 * group):
            v = centre + random.standard_normal(48) * (0.1 + 0.06 * group)
            rows.append(v * random.uniform(0.01, 100))
    rows += list(random.standard_normal((150, 48)))
    out = [(k, [float(x) for x in v]) for k, v in enumerate(rows)]
    bad = [None, [], [0.0] * 48, [1.0] * 47 + [float("nan")], [1.0] * 47 + [float("inf")], [1.0] * 47 + [None]]
    out += [(1000 + k, v) for k, v in enumerate(bad)]
    out += [(2000 + k, out[7][1]) for k in range(40)] + [(3000, [1.0, 2.0]), (3001, [2.0, 4.0]), (3002, [-1.0, -2.0]), (3003, [5.0])]
    return out


def test_links_are_those_of_the_sql(spark, by_sql):
    df = vectors(spark, *vector_rows())
    assert counted(link_vectors(df, 0.9)) == by_sql("op2_embeddings", embeddings=df)


def test_large_buckets_are_cut_into_blocks(spark, by_sql, monkeypatch):
    monkeypatch.setattr("stayline.llm.embeddings.BLOCK", 7)
    df = vectors(spark, *vector_rows())
    assert counted(link_vectors(df, 0.9)) == by_sql("op2_embeddings", embeddings=df)


def test_null_and_repeated_ids(spark):
    found = link_vectors(vectors(spark, (None, [1.0, 0.0]), (4, [1.0, 0.1]), (4, [1.0, 0.1]), (3, [1.0, 0.0]), (4, [0.0, 1.0]))).collect()
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in found), key=str)
    assert (None, 0, None, True) in got and (3, 2, 3, True) in got and got.count((4, 2, 3, False)) == 2
    assert link_vectors(vectors(spark)).collect() == []


def test_pairs_at_the_threshold_are_hardly_ever_missed(spark):
    random = np.random.default_rng(11)
    rows = []
    for k in range(1000):
        a = random.standard_normal(64)
        a /= np.linalg.norm(a)
        b = random.standard_normal(64)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        cosine = 0.9005
        for j, v in enumerate((a, cosine * a + math.sqrt(1 - cosine**2) * b)):
            rows.append((2 * k + j, [float(x) for x in v]))
    found = sum(r.n_links for r in link_vectors(vectors(spark, *rows), 0.9).collect())
    assert found >= 2 * 990
    assert tables_for(2000, 0.9)[1] > 5


def test_distrust_reaches_hosts_many_links_away(spark):
    # farm0 links to the blocked host, farm1 to farm0, and so on; twelve rounds would end halfway
    chain = [(1, "http://shop.net/es/", "")]
    chain += [(k + 2, f"http://farm{k}.org/", link(f"farm{k - 1}.org" if k else "shop.net")) for k in range(24)]
    found = {r.host: r for r in judge_urls(pages(spark, *chain), URL_RULES).collect()}
    for k in range(24):
        assert found[f"farm{k}.org"].distrust == pytest.approx(0.15 * 0.85 ** (k + 1), rel=1e-6)
    assert found["farm20.org"].verdict == "block"


def test_ranks_solve_their_equation(spark):
    draw = np.random.default_rng(2)
    rows = [(i, f"http://h{i % 12}.{'com' if i < 6 else 'org'}/", link(*[f"h{j}.org" for j in draw.integers(0, 12, 3)])) for i in range(30)]
    hosts, trust = sorted({f"h{i % 12}.{'com' if i < 6 else 'org'}" for i in range(30)}), {}
    for r in judge_urls(pages(spark, *rows), URL_RULES).collect():
        trust[r.host] = r.trust
    out = {h: [t for i, u, html in rows if u[7:-1] == h for t in html.split('https://')[1:]] for h in hosts}
    arcs = {h: [t.split("/")[0] for t in ts if t.split("/")[0] != h] for h, ts in out.items()}
    seeds = {h: sum(u[7:-1] == h for _, u, _ in rows) for h in hosts if h.endswith(".com")}
    for h in hosts:
        arriving = sum(0.85 * trust[a] * arcs[a].count(h) / len(arcs[a]) for a in hosts if arcs[a])
        assert trust[h] == pytest.approx(0.15 * seeds.get(h, 0) / sum(seeds.values()) + arriving, abs=1e-5)
