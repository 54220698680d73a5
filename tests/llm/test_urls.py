import math
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from strandmill.llm import urltree
from strandmill.llm.queries import RULES, queries


def plain(urls, rules, limit=0.5, weight=4.0, depth=4, many=20, per_child=3.0, unlike=2.58):
    """(host, path, rule, verdict, template, share) of each url, by the definitions, one step after another."""
    rows = []
    for url in urls:
        at = (url or "").find("://")
        rest = url[at + 3 :] if at >= 0 else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule = max(fits, key=lambda r: (len(r.name), r.name), default=None)
        shape = []
        for s in path.split("/"):
            if s:
                s = re.sub(r"[0-9]{4}-[0-9]{2}(-[0-9]{2})?", "{date}", s)
                s = re.sub(r"(?i)(?a:\b)[0-9a-f]*(?:[0-9][a-f]|[a-f][0-9])[0-9a-f]{6,}(?a:\b)", "{id}", s)
                shape.append(re.sub(r"[0-9]+", "{n}", s))
        rows.append((host, path, rule, tuple(shape)))
    template = {(h, s): "" for h, _, _, s in rows}
    size = defaultdict(int)
    for h, _, _, s in rows:
        size[h, s] += 1
    for level in range(depth):
        below = defaultdict(lambda: defaultdict(int))
        for (h, s), t in template.items():
            if len(s) > level:
                below[h, t][s[level]] += size[h, s]
        wild = {k for k, v in below.items() if len(v) >= many and sum(v.values()) < per_child * len(v)}
        template = {(h, s): t if len(s) <= level else f"{t}/{'*' if (h, t) in wild else s[level]}" for (h, s), t in template.items()}
    template = {(h, s): t + "/**" if len(s) > depth else t for (h, s), t in template.items()}
    bad, all_ = defaultdict(int), defaultdict(int)
    for h, _, r, s in rows:
        if r:
            all_[h, template[h, s]] += 1
            bad[h, template[h, s]] += r.verdict == "block"
    known = {(h, t) for (h, _), t in template.items()}

    def shrunk(b, n, towards):
        return (b + weight * towards) / (n + weight)

    total = sum(bad.values()) / max(sum(all_.values()), 1)
    share = {}
    for h, t in known:
        branch = lambda x: re.sub(r"^/[^/]*", "/*", x)
        same = [k for k in known if k[0] == h and branch(k[1]) == branch(t)]
        p = sum(bad[k] for k in same) / max(sum(all_[k] for k in same), 1)
        alike = lambda k: abs(bad[k] - all_[k] * p) / math.sqrt(max(all_[k] * p * (1 - p), 0.25)) <= unlike  # noqa: E731, B023
        own = [k for k in known if k[0] == h]
        of_host = shrunk(sum(bad[k] for k in own), sum(all_[k] for k in own), total)
        like = [k for k in same if alike(k)]
        towards = shrunk(sum(bad[k] for k in like), sum(all_[k] for k in like), of_host) if alike((h, t)) else of_host
        share[h, t] = shrunk(bad[h, t], all_[h, t], towards)
    out = []
    for h, p, r, s in rows:
        t = template[h, s]
        out.append((h, p, r and r.name, r.verdict if r else "block" if share[h, t] >= limit else "allow", t, share[h, t]))
    return out


def some_urls(rng, n):
    hosts = ["A.example.com", "example.com", "b.net", "example.net", "c.org", "d.example.net", "com", "x.io"]
    words = ["en", "de", "es", "fr", "7", "8", "2024-01-02", "ab12cd34ef56", "page"]
    out = [None, "", "nothing", "://", "http://", "http://x.io?q/en/", "http://x.io#a/b", "http://é.com/en/ü", "http://b.net//de///x", "a://x.io/y://z"]
    for i in range(n):
        path = "/".join(str(rng.choice(words)) for _ in range(int(rng.integers(0, 7))))
        if i % 3 == 0:
            path = f"{rng.choice(['en', 'de', 'es', 'fr'])}/{''.join(rng.choice(list('abcdefgh'), 6))}/x"
        out.append(f"http://{rng.choice(hosts)}/{path}" + str(rng.choice(["", "/", "?a=/en/", "#x"])))
    return out + ["http://x.io/" + "long/" * 30_000]


def test_against_plain_method(spark):
    for seed, n, rules in ((1, 700, RULES), (2, 300, RULES[:2]), (3, 50, [])):
        urls = some_urls(np.random.default_rng(seed), n)
        expected = plain(urls, rules)
        pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] * 1, "page_id long, url string").withColumns({"host": F.lit("clash"), "label": F.lit("x"), "template": F.lit(3)})
        got = urltree.judged_urls(pages, rules).collect()
        assert len(got) == len(urls)
        for r in got:
            host, path, rule, verdict, template, share = expected[r["id"]]
            assert (r["host"], r["path"], r["rule"], r["template"]) == (host, path, rule, template), urls[r["id"]]
            assert abs(r["share"] - share) < 1e-9 and (r["verdict"] == verdict or abs(share - 0.5) < 1e-9)


def test_query_over_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()
    expected = {p["page_id"]: e for p, e in zip(pages, plain([p["url"] for p in pages], RULES))}
    got = queries()["op5_url_templates"](spark, sf).collect()
    assert len(got) == len(pages)
    assert all((r["host"], r["path"], r["rule"], r["verdict"]) == expected[r["page_id"]][:4] for r in got)


def test_repeated_rows_and_empty_table(spark):
    pages = spark.createDataFrame([(1, "http://x.com/en/1")] * 3 + [(1, None)] * 2, "page_id long, url string")
    got = urltree.judged_urls(pages, RULES)
    assert got.count() == 5 and {r["verdict"] for r in got.where("host = 'x.com'").collect()} == {"block"}
    assert urltree.judged_urls(pages.where("false"), RULES).count() == 0
