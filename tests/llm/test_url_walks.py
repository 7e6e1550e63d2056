"""URL verdicts with settled ranks against a plain walk."""

import re
from collections import Counter

import numpy as np
import pytest

from spinelens.llm import url_filter

HREF = re.compile(r"""href\s*=\s*["']?(?:https?:)?//([^/"'?#\s>]+)""", re.I)


def host(url):
    found = re.match(r"[^/?#]*", url.split("://", 1)[1])[0] if url and "://" in url else ""
    return found.translate(str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)}))


def rule_of(h, path):
    best = None
    for action, rule in url_filter.RULES:
        where, _, rest = rule.partition("/")
        if (h == where or h.endswith("." + where)) and path.startswith("/" + rest) and (best is None or len(rule) > len(best[1])):
            best = (action, rule)
    return best


def plain(pages):
    """Verdict per page id by dense walks of 300 rounds."""
    hosts, edges, good, bad = set(), Counter(), Counter(), Counter()
    for _, url, html in pages:
        h = host(url)
        path = re.match(r"[^/?#]*([^?#]*)", url.split("://", 1)[1])[1] if url and "://" in url else ""
        if not h:
            continue
        hosts.add(h)
        rule = rule_of(h, path)
        (good if rule and rule[0] == "allow" else bad if rule else Counter())[h] += 1
        for to in map(str.lower, HREF.findall(html or "")):
            if to != h:
                edges[h, to] += 1
                hosts.add(to)
    for h in list(hosts):
        parts = h.split(".")
        chain = [".".join(parts[i:]) for i in range(max(len(parts) - 1, 1))]
        hosts.update(chain)
    for h in list(hosts):
        if h.count(".") >= 2:
            up = h.split(".", 1)[1]
            hosts.add(up)
            edges[h, up] += 1
            edges[up, h] += 1
    index = {h: i for i, h in enumerate(sorted(hosts))}
    m = np.zeros((len(index), len(index)))
    for (a, b), n in edges.items():
        m[index[a], index[b]] += n
    ranks = []
    for walk, seeds in ((m, good), (m.T, bad)):
        s = np.zeros(len(index))
        for h, n in seeds.items():
            s[index[h]] = n
        s = s / s.sum() if s.sum() else s
        out = walk.sum(1)
        step, x = walk / np.where(out > 0, out, 1)[:, None], s
        for _ in range(300):
            x = 0.15 * s + 0.85 * (x @ step + x[out == 0].sum() * s)
        ranks.append(x)
    for i, url, _ in pages:
        h = host(url)
        path = re.match(r"[^/?#]*([^?#]*)", url.split("://", 1)[1])[1] if url and "://" in url else ""
        rule = rule_of(h, path)
        if rule or not h:
            yield i, rule[0] if rule else "allow"
            continue
        t, d = (r[index[h]] for r in ranks)
        share = d / (t + d) if t + d > 0 else 0
        yield i, None if abs(share - 0.5) < 1e-3 else "block" if share > 0.5 else "allow"


def check(frame):
    rows = [(r["page_id"], r["url"], r["html"]) for r in frame.collect()]
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(frame).collect()}
    want = dict(plain(rows))
    assert all(got[i] == v for i, v in want.items() if v is not None) and len(got) == len(rows)
    return got


def test_given_pages(real):
    check(real["pages"])


def test_a_chain_of_links_to_a_blocked_host(spark):
    rows = [(0, "http://bad.net/es/x", "")] + [
        (i, f"http://h{i}.org/", f'<a href="http://{"bad.net" if i == 1 else f"h{i - 1}.org"}/">') for i in range(1, 16)]
    rows += [(100, "http://good.com/", '<a href="http://friend.org/">'), (101, "http://friend.org/", "")]
    got = check(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {got[i] for i in range(16)} == {"block"} and got[101] == "allow"


def test_ranks_settle(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0), ("b", "c", 1.0), ("c", "a", 2.0)], "src string, dst string, weight double")
    seeds = spark.createDataFrame([("a", 1.0, 0.0), ("c", 0.0, 1.0)], "host string, good double, bad double")
    settled = {r["host"]: (r["trust"], r["distrust"]) for r in url_filter.host_scores(edges, seeds).collect()}
    long = {r["host"]: (r["trust"], r["distrust"]) for r in url_filter.host_scores(edges, seeds, iterations=90).collect()}
    for h in "abc":
        assert settled[h] == pytest.approx(long[h], abs=1e-4)
