"""Crawl frontiers against brute-force Python crawls on a hand graph."""

import pytest

from sitelake.operators.frontier import crawl

N = 12
U = [f"http://s.com/{i}" for i in range(N)]
EXT = "http://x.com/a"
DEAD = "http://s.com/dead"


def graph():
    e = []
    for i in range(N):
        e.append((U[i], U[(7 * i + 1) % N], 1))
        e.append((U[i], U[(3 * i + 2) % N], 2))
    e += [(U[0], U[0], 3), (U[1], EXT, 3), (U[2], DEAD, 3), (EXT, U[9], 1), (U[3], U[5], 4), (U[4], U[5], 3)]
    return e


def host(u):
    return u.split("/")[2]


def bfs(seed, edges, max_depth, max_pages, internal, order="breadth", landed_only=True):
    out = {u: [] for u in {s for s, _, _ in edges}}
    for s, d, p in edges:
        out[s].append((p, d))
    seen = {seed: (0, ())}
    level = [seed]
    for depth in range(1, max_depth + 1):
        nxt = []
        for u in sorted(level, key=lambda x: seen[x][1]):
            for p, d in sorted(out.get(u, [])):
                if internal and host(d) != host(seed):
                    continue
                if d == DEAD and landed_only:  # reported, not visited
                    continue
                if d not in seen:
                    seen[d] = (depth, seen[u][1] + (p,))
                    nxt.append(d)
        if not nxt:
            break
        level = nxt
    key = (lambda u: (seen[u][0], seen[u][1])) if order == "breadth" else (lambda u: seen[u][1])
    ranked = sorted(seen, key=key)
    return ranked[:max_pages] if max_pages else ranked, seen


def best_first(seed, edges, max_depth, max_pages, keywords, weight):
    out = {}
    for s, d, p in edges:
        out.setdefault(s, []).append((p, d))

    def score(u):
        return weight * sum(1 for k in keywords if k.lower() in u.lower()) / len(keywords)

    visited = [seed]
    pool = {}

    def push(u, depth, path):
        for p, d in sorted(out.get(u, [])):
            if d in visited or depth + 1 > max_depth or d == DEAD:
                continue
            cand = (depth + 1, path + (p,))
            if d not in pool or cand < pool[d]:
                pool[d] = cand
    push(seed, 0, ())
    while len(visited) < max_pages and pool:
        u = min(pool, key=lambda x: (-score(x), pool[x][0], pool[x][1]))
        depth, path = pool.pop(u)
        visited.append(u)
        push(u, depth, path)
    return visited


@pytest.fixture(scope="module")
def frames(spark):
    edges = spark.createDataFrame(graph(), "src string, dst string, pos int")
    seeds = spark.createDataFrame([(0, U[0]), (1, U[3])], "seed_id long, url string")
    pages = spark.createDataFrame([(u,) for u in U + [EXT]], "url string")
    return edges, seeds, pages


def _visits(v):
    got = {}
    for r in v.filter("visit_order IS NOT NULL").orderBy("seed_id", "visit_order").collect():
        got.setdefault(r.seed_id, []).append(r.url)
    return got


@pytest.mark.parametrize("max_depth,max_pages,internal", [(20, 5, True), (2, None, True), (20, None, False), (3, 4, False)])
def test_breadth(frames, max_depth, max_pages, internal):
    edges, seeds, pages = frames
    v = crawl(edges, seeds, "breadth", max_depth=max_depth, max_pages=max_pages or 10_000,
              include_external=not internal, pages=pages)
    got = _visits(v)
    for sid, s in [(0, U[0]), (1, U[3])]:
        exp, seen = bfs(s, graph(), max_depth, max_pages, internal)
        assert got[sid] == exp
        visited = set(exp)
        if any(u in visited and seen[u][0] < max_depth for u, d, _ in graph() if d == DEAD):
            row = v.filter((v.seed_id == sid) & (v.url == DEAD)).collect()
            parents = [u for u, d, _ in graph() if d == DEAD and u in visited]
            assert len(row) == 1 and not row[0].landed and row[0].visit_order is None and row[0].parent in parents


def test_budget_is_not_filled_by_urls_without_pages(spark):
    """Three pages fit the budget although two links to missing pages come first."""
    links = [("m1", 1), ("m2", 2), ("a", 3), ("b", 4), ("c", 5)]
    edges = spark.createDataFrame([("http://s/", f"http://s/{d}", p) for d, p in links] + [("http://s/a", "http://s/m1", 1), ("http://s/a", "http://s/m3", 2)],
                                  "src string, dst string, pos int")
    seeds = spark.createDataFrame([(1, "http://s/")], "seed_id long, url string")
    pages = spark.createDataFrame([(f"http://s/{x}",) for x in ("", "a", "b", "c")], "url string")
    for strategy in ("breadth", "depth"):
        rows = {r.url[9:]: (r.visit_order, r.depth, r.landed, (r.parent or "")[9:]) for r in crawl(edges, seeds, strategy, max_pages=3, pages=pages).collect()}
        assert rows == {"": (1, 0, True, ""), "a": (2, 1, True, ""), "b": (3, 1, True, ""), "m1": (None, 1, False, ""), "m2": (None, 1, False, ""),
                        "m3": (None, 2, False, "a")}, strategy
    tables = [t.name for t in spark.catalog.listTables() if t.name.startswith("crawl_seen")]
    assert tables == []


def test_depth_preorder(frames):
    edges, seeds, pages = frames
    got = _visits(crawl(edges, seeds, "depth", max_depth=10, max_pages=6, include_external=False, pages=pages))
    for sid, s in [(0, U[0]), (1, U[3])]:
        assert got[sid] == bfs(s, graph(), 10, 6, True, order="depth")[0]


def test_best_first_exact(frames):
    edges, seeds, pages = frames
    kw = ["s.com/1", "x.com", "/5"]
    got = _visits(crawl(edges, seeds, "best", max_depth=3, max_pages=7, include_external=True, keywords=kw,
                        weight=0.7, pages=pages))
    for sid, s in [(0, U[0]), (1, U[3])]:
        assert got[sid] == best_first(s, graph(), 3, 7, kw, 0.7)


@pytest.mark.parametrize("internal", [True, False])
def test_reachability_mode(frames, internal):
    edges, seeds, pages = frames
    v = crawl(edges, seeds, "breadth", max_depth=4, include_external=not internal, keep_tree=False)
    got = {}
    for r in v.collect():
        got.setdefault(r.seed_id, {})[r.url] = r.depth
    for sid, s in [(0, U[0]), (1, U[3])]:
        _, seen = bfs(s, graph(), 4, None, internal, landed_only=False)
        assert got[sid] == {u: dp for u, (dp, _) in seen.items()}


def test_url_filter(frames):
    edges, seeds, pages = frames
    v = crawl(edges, seeds, "breadth", max_depth=5, include_external=True, url_pattern=r"/[0-5]$")
    assert all(r.url[-1] in "012345" for r in v.collect())
