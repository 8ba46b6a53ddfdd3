"""Exact top-k and URL rules."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.llm.helpers import rows_of
from tsforge.llm import exact_topk, url_filter

VECTORS = T.StructType([
    T.StructField("vec_id", T.LongType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("score", T.StringType()),
    T.StructField("rank", T.StringType()),
])


def plain_topk(rows, k, scale=256):
    good = [
        (i, [math.floor(scale * float(x)) for x in v]) for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out, seen = [], set()
    for i, v in good:
        if i % 5 or (i, tuple(v)) in seen:
            continue
        seen.add((i, tuple(v)))
        products = ((sum(a * b for a, b in zip(v, w)), j) for j, w in good if j != i)
        scored = sorted((-max(min(s, 2**63 - 1), -(2**63)), j) for s, j in products)[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    return sorted(out, key=repr)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "a", "b") for i, v in rows], VECTORS).repartition(3)


@pytest.mark.parametrize("cells", [(8_192, 2_048), (7, 3)])
def test_topk_matches_brute_force(spark, cells):
    rnd = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in np.float32(rnd.normal(size=40))]) for i in range(120)]
    rows += [(200 + i, rows[3][1]) for i in range(9)]  # ties
    rows += [(300, None), (305, [None, 1.0]), (310, [float("nan")] * 40), (315, [float("inf")]), (None, [1.0])]
    rows += [(320, []), (325, [1.0, -2.0]), (5, rows[0][1]), (10, rows[10][1])]  # short, twice under one id
    got = exact_topk.exact_topk(vectors(spark, rows), F.col("vec_id") % 5 == 0, 5, 256, 8, *cells)
    assert rows_of(got) == plain_topk(rows, 5)


def test_topk_of_large_numbers_and_few_rows(spark):
    rows = [(0, [1e30, 2.0]), (1, [-1e30, 1.0]), (2, [3.0, 4.0]), (5, [2.0**40, 2.0**41])]
    got = exact_topk.exact_topk(vectors(spark, rows), F.col("vec_id") % 5 == 0)
    assert rows_of(got) == plain_topk(rows, 5)


def test_topk_of_nothing(spark):
    assert exact_topk.exact_topk(vectors(spark, []), F.col("vec_id") % 5 == 0).count() == 0


def test_bounds_drop_candidates_but_no_results():
    rnd = random.Random(3)
    c = np.array([[rnd.choice([0, 1, 50]) if j < 8 else rnd.randint(0, 1) for j in range(32)] for _ in range(500)], float)
    q = c[:5]
    found = exact_topk.search_cell(c, np.arange(500), q, np.arange(5), 5, 8)
    for i, ids, scores in found:
        exact = sorted((-float(q[i] @ c[j]), j) for j in range(500) if j != i)[:5]
        assert [(-s, j) for j, s in zip(ids, scores)] == exact


PAGES = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
    T.StructField("host", T.StringType()), T.StructField("rule", T.StringType()),
])


def plain_verdict(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = rest[:end], rest[end:]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[1], best[2] if best else "allow"


def test_url_rules(spark):
    urls = [
        None, "", "no scheme/en/", "http://Example.NET/en/a", "https://a.b.example.net/de/", "http://net/", "http://net",
        "http://xnet/", "http://example.com/de/x?y#z", "http://EXAMPLE.com#/de/", "http://sub.org/fr/", "http://org/frx",
        "http://user:pw@example.net:80/en/", "http://İ.example.net/en/", "a://b://example.net/en/", "http://.net/",
        "http://a..net/x", "http://example.net/en", "http://example.net/en/" + "p/" * 3_000, "http://a\nb.net/\n",
    ]
    rows = [(i % 7, u, "h", "r") for i, u in enumerate(urls * 2)] + [(None, "http://a.net/", "h", "r")]
    got = rows_of(url_filter.judge_urls(spark.createDataFrame(rows, PAGES)))
    assert got == sorted(((i, *plain_verdict(u, url_filter.RULES)) for i, u, _, _ in rows), key=repr)


def test_hosts_of_many_labels_are_not_expanded_label_by_label(spark):
    urls = [f"http://{'a.' * n}{end}/en/" for n in (0, 1, 4_000, 40_000) for end in ("net", "example.net", "b.c", "net.")]
    pages = spark.createDataFrame([(i, u, "", "") for i, u in enumerate(urls)], PAGES)
    got = rows_of(url_filter.judge_urls(pages))
    assert got == sorted(((i, *plain_verdict(u, url_filter.RULES)) for i, u in enumerate(urls)), key=repr)


def test_url_rules_with_inner_prefixes_and_equal_lengths(spark):
    rules = [("a.com", "/ab", "block"), ("a.com", "", "allow"), ("b.a.com", "/x", "allow"), ("a.com", "/abcd", "allow")]
    urls = ["http://b.a.com/x", "http://a.com/abc", "http://a.com/abcde", "http://c.a.com", "http://ba.com/ab"]
    pages = spark.createDataFrame([(i, u, "", "") for i, u in enumerate(urls)], PAGES)
    got = rows_of(url_filter.judge_urls(pages, rules))
    assert got == sorted(((i, *plain_verdict(u, rules)) for i, u in enumerate(urls)), key=repr)
    assert url_filter.judge_urls(pages, []).filter("verdict = 'allow' and rule is null").count() == 5
    assert url_filter.judge_urls(spark.createDataFrame([], PAGES)).count() == 0
