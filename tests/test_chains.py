"""Ranks of page chains against walks from page to page."""

import random

from tsforge.operators.chains import chain_report, page_chains


def walked(links):
    """(series, token) -> (chain, steps, missing, cycle), page by page."""
    out = {}
    for series, token in links:
        seen, at = [], token
        while at not in seen:
            seen.append(at)
            ahead = links[series, at]
            if ahead is None or (series, ahead) not in links:
                out[series, token] = (at, len(seen) - 1, ahead, False)
                break
            at = ahead
        else:
            out[series, token] = (min(seen[seen.index(at) :]), None, None, True)
    return out


def test_chains_equal_walks(spark):
    rnd = random.Random(1)
    rows = []
    for series in ("a", None):
        order = [f"t{i:03d}" for i in range(150)]
        rnd.shuffle(order)
        rows += [(series, x, y) for x, y in zip(order, [*order[1:], None]) if rnd.random() > 0.05]
        rows += [(series, f"c{i}", f"c{(i + 1) % 5}") for i in range(5)]  # a cycle
        rows += [(series, "in", "c3"), (series, "self", "self"), (series, None, order[0]), (series, "x", order[3])]
    links = {(s, t): n for s, t, n in rows}
    pages = spark.createDataFrame(rows + rows[:20], "series string, token string, next_token string").repartition(3)
    got = page_chains(pages, ["series"]).collect()
    assert {(r["series"], r["token"]): (r["chain"], r["steps"], r["missing"], r["cycle"]) for r in got} == walked(links)
    assert len(got) == len(links)
    report = chain_report(page_chains(pages, ["series"]), ["series"]).collect()
    assert sum(r["pages"] for r in report) == len(links)
    assert page_chains(pages.limit(0), ["series"]).count() == 0
