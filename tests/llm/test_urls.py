from __future__ import annotations

import random

from quirelake.llm import urls as u

PAGES = "page_id long, url string, html string, host string"


def plain(url, rules, default="allow"):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        tail = rest[end:]
        path = tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
    best = None
    for action, h, p in rules:
        if None in (action, h, p):
            continue
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            rank = (len(h) + len(p), action == "block")
            if best is None or rank > best[0]:
                best = (rank, h + p, action)
    return host, path, best and best[1], best[2] if best else default


def check(spark, links, rules, parts):
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        pages = spark.createDataFrame([(i, x, "", "x") for i, x in enumerate(links)], PAGES)
        table = spark.createDataFrame(rules, "action string, host string, path string")
        rows = sorted(u.judge(pages, table).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert [(r.host, r.path, r.rule, r.verdict) for r in rows] == [plain(x, rules) for x in links]


ODD = [None, "", "no scheme/net/", "http://", "http://net", "http://net/", "x://NET/a", "http://a.net/en/?q#f", "http://example.net/en/x", "http://b.example.net/en",
       "http://b.example.net/en/", "http://xexample.net/en/", "a://b://net/", "http://org/fr/", "http://x.org/fr/1", "http://x.org/de", "http://net./",
       "http://.net/", "http://example.com/de/", "http://é.EXAMPLE.com/de/é", "http://example.com?/de/", "http://u@a.net:80/", "http://a..net/x", "http://net/" + "y" * 50_000]


def test_given_rules(spark):
    check(spark, ODD * 2, list(u.RULES), 3)


def test_random_rules_in_many_ranges(spark):
    rng = random.Random(9)
    label = lambda: rng.choice(["a", "b", "ab", "a-b", "c", "é"])
    host = lambda most: ".".join(label() for _ in range(rng.randrange(1, most)))
    path = lambda: "".join(rng.choice(["/", "x", "/x", "y/"]) for _ in range(rng.randrange(4)))
    rules = [(rng.choice(["allow", "block"]), host(4), path()) for _ in range(60)]
    # Of equally long rules that fit, the answer is open unless they are the same rule.
    lengths = {}
    for a, h, p in rules:
        lengths.setdefault(h, []).append((a, h, p))
    rules += [("allow", "a", "/x"), ("block", "a", "/x"), (None, "b", "/"), ("block", None, "/"), ("block", "c", None)]
    links = [f"http://{host(6)}{path()}" for _ in range(900)] + ["http://b.a/x"] * 300
    unclear = [x for x in links if len({r[1] + "|" + r[2] for r in rules if None not in r and plain(x, [r])[2] is not None and len(r[1] + r[2]) == len(plain(x, rules)[2] or "")}) > 1]
    check(spark, [x for x in links if x not in set(unclear)], rules, 11)


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://net/", "", "x")], PAGES)
    rules = spark.createDataFrame([], "action string, host string, path string")
    assert [tuple(r) for r in u.judge(pages, rules).collect()] == [(1, "net", "/", None, "allow")]
    assert u.report(pages.limit(0)).count() == 0
