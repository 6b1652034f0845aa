import math

import numpy as np
import pytest

from ironsieve.llm import queries as q
from ironsieve.llm.embedding_dedup import near_duplicate_vectors, quantise, tile_links, unit_rows
from ironsieve.llm.mixing import mix_sources
from ironsieve.llm.url_filter import filter_urls, judge_by_table, page_links
from ironsieve.session import read_table
from tests.oracle import difference, views

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_same_as_sql(spark, name):
    assert difference(q.queries()[name](spark, SF), views(SF), q.oracle_sql()[name]) == ""


def brute_vectors(rows, threshold):
    """{row number: (links, component)} by comparing all pairs in double precision."""
    fine = {}
    for k, (i, v, label) in enumerate(rows):
        if v is not None and label is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float32).astype(float)
            fine[k] = (i, x / np.sqrt(x @ x), label)
    up, links = {r[0]: r[0] for r in rows}, dict.fromkeys(range(len(rows)), 0)

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in fine:
        for b in fine:
            if a < b and fine[a][2] == fine[b][2] and len(fine[a][1]) == len(fine[b][1]) and fine[a][1] @ fine[b][1] >= threshold:
                links[a] += 1
                links[b] += 1
                p, s = sorted((root(fine[a][0]), root(fine[b][0])))
                up[s] = p
    return sorted((rows[k][0], links[k], root(rows[k][0])) for k in range(len(rows)))


def test_vectors_against_brute_force(spark):
    r = np.random.default_rng(5)
    base = r.normal(size=(12, 16))
    rows = [(int(i), (base[r.integers(12)] + r.normal(size=16) * r.choice([0, 0.05, 0.12, 0.3])).astype(np.float32).tolist(), int(r.integers(2))) for i in r.permutation(220)]
    rows += [(500 + i, rows[3][1], rows[3][2]) for i in range(40)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [math.nan] + [1.0] * 15, 1), (903, [None] + [1.0] * 15, 1), (904, rows[0][1], None), (905, [], 1), (906, [1.0, 2.0], 1), (907, [math.inf] * 16, 1), (908, [2.0, 4.0], 1), (909, [1e-30, 2e-30], 1)]
    df = spark.createDataFrame([(*x, 0, "n") for x in rows], "vec_id long, embedding array<float>, label int, links int, node string")
    got = near_duplicate_vectors(df, 0.98, tile=32).collect()
    assert sorted((x.vec_id, x.n_links, x.component_id) for x in got) == brute_vectors(rows, 0.98)
    assert all(x.kept == (x.vec_id == x.component_id) for x in got)
    assert near_duplicate_vectors(df.limit(0)).collect() == []


def test_bound_holds_for_every_pair():
    r = np.random.default_rng(1)
    u, v = unit_rows(r.normal(size=(50, 1500))), unit_rows(r.normal(size=(60, 1500)))
    a, b = quantise(u), quantise(v)
    near = (a.first.astype(int) @ b.first.astype(int).T) * a.step[:, None] * b.step
    bound = a.norm[:, None] * b.lost + a.lost[:, None] * b.norm + a.lost[:, None] * b.lost
    assert (np.abs(u @ v.T - near) <= bound).all()
    every = a.fine(np.arange(50)) @ b.fine(np.arange(60)).T
    bound = (1 + a.least[:, None]) * b.least + (1 + b.least) * a.least[:, None] + a.least[:, None] * b.least
    assert (np.abs(u @ v.T - every) <= bound).all() and (b.least < b.lost / 100).all()
    want = {(i, j) for i, j in zip(*np.nonzero(u @ v.T >= 0.02), strict=True)}
    found = [(i, j, s) for x in tile_links(a, b, 0.02) for i, j, s in zip(*x, strict=True)]
    sure, unsure = {(i, j) for i, j, s in found if s}, {(i, j) for i, j, s in found if not s}
    assert sure <= want <= sure | unsure and len(unsure) < 20


def test_pairs_at_the_threshold_are_compared_in_double_precision(spark):
    r = np.random.default_rng(6)
    rows, want = [], {}
    for k in range(60):  # pairs whose cosine is 0.98 give or take far less than the bytes can tell
        x, y = unit_rows(r.normal(size=(2, 32)))
        y -= (x @ y) * x
        y /= np.sqrt(y @ y)
        c = 0.98 + (1e-9 if k % 2 else -1e-9)
        rows += [(2 * k, (x * 3).tolist(), k), (2 * k + 1, (c * x + math.sqrt(1 - c * c) * y).tolist(), k)]
        want |= {2 * k: k % 2, 2 * k + 1: k % 2}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert {x.vec_id: x.n_links for x in near_duplicate_vectors(df).collect()} == want


def test_urls(spark):
    html = '<link rel="canonical" href="{}">'
    pages = [
        (1, "https://a.org/x", html.format("https://spam.net/es/1")),
        (2, "http://b.org/y#f", "<META http-equiv='refresh' content='0; url=https://a.org/x'>"),
        (3, "https://c.org/z", html.format("/es/q") + html.format("https://www.example.com/en/ok")),
        (4, "https://D.ORG/z", html.format("https://c.org/z") + html.format("https://e.net/fr/1")),
        (5, "no url", html.format("https://spam.net/es/1")),
        (6, None, None),
        (7, "https://EXAMPLE.com/en/p?q=/x", None),
        (8, "x://www.example.com/en/", ""),
        (9, "https://myexample.com/en/", ""),
        (10, "https://example.com", ""),
        (11, "https://b.org/y", None),
        (11, "https://b.org/y", None),
    ]
    df = spark.createDataFrame([(*p, "c") for p in pages], "page_id long, url string, html string, component string")
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(df, q.URL_RULES).collect()}
    assert out[1] == ("a.org", "/x", None, "block")
    assert out[2][3] == "block" and out[11][3] == "block"
    assert out[3][3] == "allow" and out[4] == ("d.org", "/z", None, "allow")
    assert out[5] == ("", "", None, "allow") and out[6] == ("", "", None, "allow")
    assert out[7] == ("example.com", "/en/p", "example.com/en/", "block")
    assert out[8][2:] == ("www.example.com/en/", "allow") and out[9][2:] == ("com/", "allow") and out[10][1:] == ("", None, "allow")
    moved = spark.createDataFrame([("https://example.com", "https://spam.net/es/1")], "from_url string, to_url string")
    assert {r.page_id: r.verdict for r in filter_urls(df, q.URL_RULES, moved).collect()}[10] == "block"
    assert filter_urls(df.limit(0), q.URL_RULES).collect() == []


def test_relative_targets(spark):
    from urllib.parse import urljoin

    bases = ["https://n.net/it/a", "http://n.net", "https://N.net/it/", "https://n.net/it/b/c?q=/x/y#f"]
    targets = ["page2.html", "../fr/a", "?id=3", "./x/./y/..", "/a/../fr/b", "../../../z?u=https://o.org/../k", ".", "a/b", "//o.org/p", "https://o.org/p/../q", "q&amp;r", "mailto:x@y.z", "a:b/c", "#top", "..x/.y"]
    rows = [(b, f"<link rel=canonical href='{t}'>") for b in bases for t in targets]
    rows += [("https://n.net/it/a", '<meta http-equiv="refresh" content="0; url=next.html">'), ("https://n.net/it/a", '<base href="../fr/"><link rel="canonical" href="c">')]
    want = set()
    for b, t in [(b, t) for b in bases for t in targets] + [("https://n.net/it/a", "next.html"), ("https://n.net/fr/", "c")]:
        if t not in ("mailto:x@y.z", "a:b/c", "#top"):
            own = "https://n.net/it/a" if t == "c" else b
            whole = t if "://" in t[:9] else urljoin(b, t.replace("&amp;", "&"))
            cut = lambda u: u.split("://", 1)[1].split("#")[0].replace("N.net", "n.net")
            if cut(own) != cut(whole):
                want.add((cut(own), cut(whole)))
    df = spark.createDataFrame(rows, "url string, html string")
    assert {tuple(r) for r in page_links(df).collect()} == want
    pages = spark.createDataFrame([(1, "https://net/it/a", "<link rel=canonical href='../fr/a'>"), (2, "https://net/it/b", None)], "page_id long, url string, html string")
    assert {r.page_id: r.verdict for r in filter_urls(pages, q.URL_RULES).collect()} == {1: "block", 2: "allow"}


def test_urls_same_as_sql_on_linked_pages(spark, tmp_path):
    import random

    r = random.Random(3)
    hosts = ["a.net", "b.net", "www.example.com", "shop.example.com", "c.org", "D.org", "x.com"]
    at = lambda: f"{r.choice(['http', 'https'])}://{r.choice(hosts)}/{r.choice(['es/', 'fr/', 'en/', 'it/', ''])}{r.randrange(12)}{r.choice(['', '', '?q=1', '#f'])}"
    link = lambda t: r.choice([f'<link rel="canonical" href="{t}">', f"<META http-equiv='refresh' content='0; url={t}'>", f"<link href={t} rel=canonical>", f'<link rel="stylesheet" href="{t}">'])
    target = lambda: r.choice([at(), at(), "../fr/3", "4", "/es/./x/../5", "?id=3", "#top", "mailto:x@y.z", "//b.net/it/2", "./.."])
    rows = []
    for k in range(400):
        html = "".join(link(target()) for _ in range(r.choice([0, 0, 1, 1, 2])))
        rows.append((k, at() if r.random() < 0.95 else r.choice([None, "no url", ""]), (r.choice(["", "", '<base href="/fr/">']) + html) if r.random() < 0.95 else None))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    df.toPandas().to_parquet(tmp_path / "pages.parquet")
    got = filter_urls(df, q.URL_RULES).drop("component")
    assert difference(got, views(str(tmp_path)), q.oracle_sql()["op2_url_filter"]) == ""
    assert len({(x.rule, x.verdict) for x in got.where("rule is null").collect()}) == 2


def test_urls_by_rule_table(spark):
    pages = read_table(spark, SF, "pages")
    rules = spark.createDataFrame(list(q.URL_RULES), "verdict string, host string, path string")
    assert sorted(filter_urls(pages, rules).collect()) == sorted(filter_urls(pages, q.URL_RULES).collect())
    assert "hit" in judge_by_table(spark.createDataFrame([("a.com", "/")], "host string, path string"), rules).columns


def water(sizes, weights, total, limit):
    """Targets by sharing what is over again and again."""
    full, out = set(), {}
    while True:
        left = total - sum(limit * sizes[s] for s in full)
        open_ = [s for s in sizes if s not in full]
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_} if open_ else {}
        over = [s for s in open_ if share[s] > limit * sizes[s]]
        if not over:
            return out | {s: limit * sizes[s] for s in full} | share
        full |= set(over)


def test_mixing(spark):
    r = np.random.default_rng(2)
    names = ["b", "a", "é", None, "Z", "zz"]
    rows = [(i, " ".join(["w"] * int(r.integers(0, 60))), names[min(5, int(r.geometric(0.4)) - 1)], i, 1) for i in range(600)]
    rows += [(700, None, "a", 0, 0), (701, "", "b", 0, 0), (None, "x y", "a", 0, 0), (5, rows[5][1], rows[5][2], 5, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, target int")
    got = mix_sources(df).collect()
    assert len(got) == len(rows)
    sizes = {}
    for x in got:
        sizes[x.source] = sizes.get(x.source, 0) + x.size
    order = sorted(sizes, key=lambda s: (s is None, s))
    want = water(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(sizes.values()), 2)
    for s in sizes:
        own = [x for x in got if x.source == s]
        assert all(x.source_size == sizes[s] and abs(x.target - want[s]) < 1e-6 for x in own)
        assert sum(x.taken for x in own) == math.floor(own[0].target + 1e-9) and all(0 <= x.taken <= 2 * x.size for x in own)
    assert sorted(map(str, got)) == sorted(map(str, mix_sources(df.repartition(7), ranges=3).collect()))
    assert mix_sources(df.limit(0)).collect() == []
