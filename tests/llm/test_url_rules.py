"""Mined url rules against all token sets counted by hand, with planted labels."""

from __future__ import annotations

import random
import re
from itertools import combinations

from dossier.llm import url_filters

LIMITS = {"min_rows": 10, "min_confidence": 0.6, "min_lift": 1.5, "min_z": 4.0, "max_share": 0.9}


def tokens(url):
    return sorted({t for t in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), url)) if t})


def planted(n=900, seed=4):
    """Urls of which those with both promo and win, and those of the host casino, are mostly bad; others seldom."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        words = rng.sample(["promo", "win", "news", "shop", "blog", "tag"], rng.randint(1, 4))
        host = rng.choice(["casino", "a", "b", "c", "d"])
        likely = 0.9 if host == "casino" or {"promo", "win"} <= set(words) else 0.05
        rows.append((f"https://{host}.example.com/{'/'.join(words)}/{i}", rng.random() < likely))
    return rows


def brute_rules(rows, min_rows, min_confidence, min_lift, min_z, max_share):
    n, n_bad = len(rows), sum(bad for _, bad in rows)
    sets = [(tokens(u), bad) for u, bad in rows]
    count = {}
    for t, _ in sets:
        for x in t:
            count[x] = count.get(x, 0) + 1
    seen = {}
    for t, bad in sets:
        t = [x for x in t if count[x] < max_share * n]
        for k in range(1, len(t) + 1):
            for c in combinations(t, k):
                a = seen.setdefault(c, [0, 0])
                a[0] += 1
                a[1] += bad
    base = n_bad / n
    good = {
        c: (b, m) for c, (m, b) in seen.items()
        if b >= min_rows and b / m >= min_confidence and b / m >= min_lift * base and b > m * base and (b - m * base) ** 2 >= min_z**2 * base * (1 - base) * m
    }
    return {c: v for c, v in good.items() if not any(set(d) < set(c) for d in good)}


def test_rules_equal_all_sets_counted(spark):
    rows = planted()
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    got = {tuple(r["tokens"]): (r["n_bad"], r["n_rows"]) for r in url_filters.mine_rules(labelled, **LIMITS).collect()}
    want = brute_rules(rows, **LIMITS)
    assert got == want and {("casino",), ("promo", "win")} <= got.keys()


def test_matches_equal_brute_force_and_name_the_rule(spark):
    rows = planted()
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    urls = [u for u, _ in planted(200, 9)] + ["https://x.org/win", "http://casino.org/promo/win", "", "HTTPS://CASINO.example/", "https://z/" + "long/" * 20000 + "casino"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    want = brute_rules(rows, **LIMITS)
    for r in url_filters.judge(pages, labelled, (), **LIMITS).collect():
        fits = sorted((-b / m, -m, c) for c, (b, m) in want.items() if set(c) <= set(tokens(urls[r["page_id"]])))
        assert (r["verdict"], r["mined_rule"]) == (("block", " ".join(fits[0][2])) if fits else ("allow", None))


def test_chance_makes_no_rule(spark):
    rng = random.Random(2)
    rows = [(u, rng.random() < 0.26) for u, _ in planted(600)]
    assert url_filters.mine_rules(spark.createDataFrame(rows, "url string, bad boolean")).count() == 0


def test_odd_rows(spark):
    """Null, empty and repeated urls, null labels, empty tables, string ids and clashing columns."""
    labelled = spark.createDataFrame([(u, b) for u, b in planted()] + [(None, True), ("http://q", None)], "url string, bad boolean")
    urls = [None, None, "", "no scheme", "http://casino.example.com/a", "http://casino.example.com/a"]
    pages = spark.createDataFrame([(f"p{i}", u, "x", 1.0) for i, u in enumerate(urls)], "page_id string, url string, rule string, confidence double")
    got = {r["page_id"]: (r["host"], r["verdict"]) for r in url_filters.judge(pages, labelled).collect()}
    assert got == {"p0": ("", "allow"), "p1": ("", "allow"), "p2": ("", "allow"), "p3": ("", "allow"), "p4": ("casino.example.com", "block"), "p5": ("casino.example.com", "block")}
    assert url_filters.judge(pages.limit(0), labelled).count() == 0
    assert {r["verdict"] for r in url_filters.judge(pages, labelled.limit(0)).collect()} == {"allow"}
    null_ids = spark.createDataFrame([(None, None), (None, "http://casino.org"), (1, None)], "page_id bigint, url string")
    assert sorted(r["verdict"] for r in url_filters.judge(null_ids, labelled, ()).collect()) == ["allow", "allow", "block"]
