from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from recollect.llm import urlfilter
from recollect.llm.queries import RULES


def as_regex(glob):
    return re.compile("".join("(?s:.*)" if p == "**" else "[^/]*" if p == "*" else re.escape(p) for p in re.split(r"(\*\*|\*)", glob)))


def test_automaton_matches_regular_expressions():
    rng = random.Random(3)
    globs = ["".join(rng.choice(["a", "b", "/", ".", "*", "**"]) for _ in range(rng.randrange(0, 40))) for _ in range(40)]
    globs = [g.replace("***", "**").replace("***", "**").replace("***", "**") for g in globs] + ["", "*", "**", "abc" * 30]
    texts = ["".join(rng.choice("ab/.") for _ in range(rng.randrange(0, 60))) for _ in range(300)] + ["", "abc" * 30, "ü/ö"]
    got = urlfilter.Automaton(globs).matches([t.encode() for t in texts])
    for i, t in enumerate(texts):
        for j, g in enumerate(globs):
            assert got[i, j] == bool(as_regex(g).fullmatch(t)), (g, t)


def test_rules(spark):
    urls = [
        "http://a.net/x", "http://net/", "http://net", "http://planet/x", "https://EXAMPLE.net/en/a", "http://m.example.net/en/",
        "http://example.net/EN/", "http://x.example.com/de/1?x=/fr/", "http://example.com/de", "http://a.org/fr/", "http://a.org/x/fr/",
        "http://b.com/a.net/x", "http://ads-track.b.com/", "http://b.com/ads-track.x", None, "no scheme.net/", "://net/", "http://q.net?x/",
        "http://u.org/fr/#x", "x" * 5000 + "://a.net/" + "y" * 5000, "http://net/\n://org/fr/",
    ]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id bigint, url string, host string")
    got = {r["page_id"]: r for r in urlfilter.filter_urls(df, RULES, [("block", "*ads-track.**")]).collect()}

    def plain(u):
        host, path = "", ""
        if u is not None and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host):])[0]
            host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fits = [(len(r), r, v) for v, r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/"):])]
        if fits:
            return host, path, max(fits)[1], max(fits)[2]
        return host, path, None, "block" if as_regex("*ads-track.**").fullmatch(host + path) else "allow"

    for i, u in enumerate(urls):
        assert tuple(got[i][c] for c in ("host", "path", "rule", "verdict")) == plain(u), u
    assert urlfilter.filter_urls(df.limit(0), RULES).count() == 0
    none = urlfilter.filter_urls(df.select("page_id", "url", F.lit(1).alias("verdict")), []).collect()
    assert {r["verdict"] for r in none} == {"allow"}
