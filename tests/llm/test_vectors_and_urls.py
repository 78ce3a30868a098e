"""Top-k search and URL filter against brute force, and on odd input."""

import math
import random

import pytest

from quorica.llm import topk, url_filter, vectors
from quorica.llm.common import prepared

VECTORS = "vec_id long, embedding array<float>, score string, block string, uid string"
BIG_ID = (1 << 60) + 20


def brute_top(rows, k):
    whole = []
    for i, v in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole.append((i, [math.floor(64 * x) for x in v]))
    out = []
    for qi, q in whole:
        if qi is None or qi % 20:
            continue
        hits = [(-sum(a * b for a, b in zip(q, c)), i is None, i) for i, c in whole if i != qi]
        hits.sort(key=lambda h: (h[0], h[1], h[2] or 0))
        out += [(qi, r, h[2], -h[0]) for r, h in enumerate(hits[:k], 1)]
    return sorted(map(str, out))


def found(spark, rows, **options):
    frame = spark.createDataFrame([(i, v, "x", "y", "z") for i, v in rows], VECTORS).repartition(3)
    return sorted(str(tuple(r)) for r in topk.top_k(frame, **options).collect())


@pytest.mark.parametrize("block_rows", [10, 64, 4096])
@pytest.mark.parametrize("even", [True, False])
def test_top_k_against_all_pairs(spark, block_rows, even):
    """Even lengths leave the work to the partial sums, uneven ones to the order of lengths."""
    prepared(spark)
    draw = random.Random(1)
    rows = []
    for i in range(300):
        v = [draw.gauss(0, 1) for _ in range(24)]
        size = math.sqrt(sum(x * x for x in v)) * (1 if even else 0.2 + 20 * draw.random() ** 4)
        rows.append((i, [x / size for x in v]))
    rows += [(1000 + i, rows[7][1]) for i in range(60)]
    assert found(spark, rows, k=5, block_rows=block_rows) == brute_top(rows, 5)


def test_odd_vectors(spark):
    v = [0.5, -0.25, 1.0]
    rows = [(0, v), (20, v), (1, v), (2, None), (3, [1.0, None, 2.0]), (4, [float("nan"), 1.0, 1.0])]
    rows += [(5, [float("inf"), 0.0, 0.0]), (None, v), (6, [2.0]), (7, []), (BIG_ID, v), (40, [0.0, 0.0, 0.0])]
    assert found(spark, rows, k=20) == brute_top(rows, 20)
    assert found(spark, [], k=20) == []
    assert found(spark, [(0, v)], k=20) == []


def test_products_beyond_floats(spark):
    """The order is exact at any size; a score beyond 64 bits is returned as the edge of the range."""
    rows = [(i, [float(2**22 + i), float(2**21), -3.0]) for i in range(45)]
    assert found(spark, rows, k=3) == brute_top(rows, 3)
    rows = [(i, [float(2**27 + 16 * i), float(2**26), -3.0]) for i in range(45)]
    edge = (1 << 63) - 1
    assert found(spark, rows, k=3) == sorted(str(eval(r)[:3] + (edge,)) for r in brute_top(rows, 3))


@pytest.mark.parametrize("leading", [1, 4, 16])
@pytest.mark.parametrize("parts", [1, 4, 64])
def test_any_number_of_partitions_and_axes(spark, monkeypatch, parts, leading):
    """Results don't depend on how many partitions the range shuffle gives, nor on tiles, chunks and the basis."""
    monkeypatch.setattr(topk, "TILE_ROWS", 7)
    monkeypatch.setattr(topk, "OPENING_ROWS", 10)
    monkeypatch.setattr(topk, "BASIS_DIMENSIONS", 12)
    monkeypatch.setattr(vectors, "CHUNK_BYTES", 16 * 8 * 9)
    draw = random.Random(parts)
    scale = [2.0 ** -j for j in range(16)]
    rows = [(i, [draw.gauss(0, 1) * s for s in scale]) for i in range(400)]
    rows += [(1000 + i, rows[40][1]) for i in range(200)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert found(spark, rows, k=5, block_rows=32, leading=leading) == brute_top(rows, 5)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def urls():
    return [
        None, "", "no scheme.net/x", "://", "http://", "HTTP://A.Example.NET/en/1?q#f", "http://net/", "http://x.net",
        "http://xnet/a", "http://example.com/de/2", "http://sub.example.com/de", "http://e.org/fr/?x=://y/", "http://e.org?fr/",
        "http://e.org#/fr/", "ftp://é.Org/fr/ü", "a://b://c/d", "http://bad.host.xyz/1", "http://good.host.xyz/1",
    ]


def brute_parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    end = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return host, path[:end]


def brute_rule(host, path):
    fits = []
    for verdict, rule in url_filter.RULES:
        at, _, below = rule.partition("/")
        if (host == at or host.endswith("." + at)) and path.startswith("/" + below):
            fits.append((len(rule), rule, verdict))
    return max(fits)[1:] if fits else (None, None)


PAGES = "page_id long, url string, html string, host string, path string, rate string, n string"
LABELS = "doc_id long, quality int, toxic int, bad string"


def test_parts_rules_and_odd_rows(spark):
    rows = [(i, u, None, "x", "y", "z", "w") for i, u in enumerate(urls())]
    rows += [(None, "http://q.xyz/", "", "", "", "", ""), rows[5]]
    labels = [(1, None, None, "x"), (None, 0, 1, "x"), (16, 0, 0, "x"), (16, 1, 0, "x"), (77, 1, 1, "x")]
    pages, outcomes = spark.createDataFrame(rows, PAGES), spark.createDataFrame(labels, LABELS)
    got = url_filter.judge_urls(pages, outcomes).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id is not None:
            assert (r.host, r.path) == brute_parts(urls()[r.page_id])
            rule, verdict = brute_rule(r.host, r.path)
            assert r.rule == rule and (rule is None or r.verdict == verdict)
            assert r.verdict in ("allow", "block")
    assert url_filter.judge_urls(pages.limit(0), outcomes).count() == 0
    assert url_filter.judge_urls(pages, outcomes.limit(0)).where("rule is null and verdict = 'block'").count() == 0


def test_reputation_needs_evidence_and_borrows_it(spark):
    """A host with many bad pages is blocked, one with a single bad page is not; siblings of bad hosts lean to bad."""
    pages, labels = [], []

    def add(host, bad, good, blank=0):
        for outcome, n in ((0, bad), (1, good), (None, blank)):
            for _ in range(n):
                i = len(pages)
                pages.append((i, f"http://{host}/p{i}", "", "", "", "", ""))
                if outcome is not None:
                    labels.append((i, outcome, 0, ""))

    add("spam.farm.xyz", 60, 2)
    for i in range(30):
        add(f"h{i}.fine.abc", 0, 20)
        add(f"s{i}.rotten.xyz", 20, 0)
    add("once.fine.abc", 1, 0, 3)
    add("unseen.rotten.xyz", 0, 0, 3)
    add("mixed.fine.abc", 5, 20)
    frame = spark.createDataFrame(pages, PAGES)
    got = url_filter.judge_urls(frame, spark.createDataFrame(labels, LABELS)).select("host", "verdict").distinct().collect()
    verdict = dict(map(tuple, got))
    assert len(verdict) == len(got)
    assert verdict["spam.farm.xyz"] == "block" and verdict["s3.rotten.xyz"] == "block"
    assert verdict["unseen.rotten.xyz"] == "block"
    assert verdict["once.fine.abc"] == "allow" and verdict["mixed.fine.abc"] == "allow" and verdict["h3.fine.abc"] == "allow"


def test_sites_domains_and_suffixes(spark):
    cases = {
        "http://User:pw@Shop.Example.co.uk:8080/x": ("shop.example.co.uk", "example.co.uk", "co.uk"),
        "http://co.uk/": ("co.uk", "co.uk", "co.uk"),
        "http://co.uk:8080/": ("co.uk", "co.uk", "co.uk"),
        "http://a.b.example.de./": ("a.b.example.de", "example.de", "de"),
        "http://10.0.0.1:81/": ("10.0.0.1", "10.0.0.1", url_filter.ADDRESSES),
        "http://[::1]:80/": ("[::1]", "[::1]", url_filter.ADDRESSES),
        "http://localhost": ("localhost", "localhost", "localhost"),
        "http://x.y.deep.k12.zz/": ("x.y.deep.k12.zz", "y.deep.k12.zz", "deep.k12.zz"),
        "no host": ("", "", ""),
        "http://" + "a." * 400 + "com/": ("a." * 400 + "com", "a.com", "com"),
    }
    pages = spark.createDataFrame(list(enumerate(cases)), "page_id long, url string")
    sites = url_filter.with_parts(pages).select("site").distinct()
    given = [*url_filter.PUBLIC_SUFFIXES, "k12.zz", "deep.k12.zz"]
    for suffixes in (given, spark.createDataFrame([(s,) for s in given + given], "suffix string")):
        got = {r.site: (r.site, r.domain, r.suffix) for r in url_filter.with_domains(sites, suffixes).collect()}
        assert got == {want[0]: want for want in cases.values()}
    plain = {r.domain for r in url_filter.with_domains(sites, []).collect()}
    assert {"co.uk", "k12.zz", "10.0.0.1"} <= plain


def test_ports_share_a_reputation_and_neighbours_of_a_suffix_do_not(spark):
    pages, labels = [], []
    for i in range(60):
        pages.append((i, f"http://u@bad.co.uk:{i}/"))
        labels.append((i, 0, 0))
        pages.append((1000 + i, f"http://good{i}.co.uk/"))
        labels.append((1000 + i, 1, 0))
    pages += [(5000, "http://bad.co.uk/"), (5001, "http://new.co.uk/")]
    frame = spark.createDataFrame(pages, "page_id long, url string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    verdict = {r.page_id: r.verdict for r in url_filter.judge_urls(frame, marks).collect()}
    assert verdict[5000] == verdict[3] == "block"
    assert verdict[5001] == verdict[1003] == "allow"


def test_any_number_of_rules(spark):
    """Joined rules give what the rules of the plan give, and thousands are no more than a join."""
    rows = list(enumerate([*urls(), "http://h7.many.org/p/7/x", "http://deep.h9.many.org/p/", "http://h9.many.org/q"]))
    parts = url_filter.with_parts(spark.createDataFrame([*rows, rows[5]], "page_id long, url string"))
    odd = [*url_filter.RULES, ("allow", "net/"), ("block", "bad.host.xyz"), ("allow", "/"), ("allow", "é.org/f"), ("block", "org/")]
    many = odd + [("block", f"h{i}.many.org/p/{i if i % 2 else ''}") for i in range(3000)]
    pick = lambda df: sorted((r.page_id, r.match and tuple(r.match)) for r in df.collect())
    framed = spark.createDataFrame(odd, "verdict string, rule string")
    assert pick(url_filter.with_rules(parts, framed)) == pick(url_filter.with_rules(parts, odd))
    got = dict(pick(url_filter.with_rules(parts, many)))
    n = len(urls())
    assert got[n] == ("block", "h7.many.org/p/7") and got[n + 1] == ("block", "org/") and got[n + 2] == ("block", "org/")
    assert all(match is None for _, match in pick(url_filter.with_rules(parts, [])))
    assert all(match is None for _, match in pick(url_filter.with_rules(parts, framed.limit(0))))
