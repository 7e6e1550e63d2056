"""URL verdicts: explicit rules first, then trust and distrust spread over the host graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spinelens.llm._store import settle, sized

#: Action and rule (host, then path); a rule fits its host and subdomains.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
DAMPING = 0.85
#: The walks end when both ranks together change by less than this in a round. Each round shrinks the change by the
#: damping at least, so at 0.85 it takes at most 76 rounds, and hosts further than that from any seed are not reached.
TOLERANCE = 1e-5
#: Weight of the edges between a host and its parent domain, beside one per link.
DOMAIN_WEIGHT = 1.0
#: A host is blocked if its share of distrust in both exceeds this.
THRESHOLD = 0.5
#: Edges per partition of a round at least; fewer would make its shuffles mostly empty files.
PARTITION_EDGES = 100_000


def host_of(url: str) -> str:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return (f"coalesce(CASE WHEN instr({url}, '://') > 0 THEN translate(regexp_extract(substring({url},"
            f" instr({url}, '://') + 3), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END, '')")


def path_of(url: str) -> str:
    return (f"coalesce(CASE WHEN instr({url}, '://') > 0 THEN regexp_extract(substring({url},"
            f" instr({url}, '://') + 3), '^[^/?#]*([^?#]*)', 1) END, '')")


def _first_fit(rules, what) -> str:
    """The longest fitting rule wins; of equals, the first listed."""
    cases = []
    for action, rule in sorted(rules, key=lambda r: -len(r[1])):
        host, slash, rest = rule.partition("/")
        quoted = [s.replace("\\", "\\\\").replace("'", "\\'") for s in (host, slash + rest, what(action, rule))]
        cases.append(f"WHEN (host = '{quoted[0]}' OR endswith(host, '.{quoted[0]}')) AND startswith(path, '{quoted[1]}')"
                     f" THEN '{quoted[2]}'")
    return f"CASE {' '.join(cases)} END" if cases else "CAST(NULL AS STRING)"


def host_edges(pages: DataFrame, *, domain_weight: float = DOMAIN_WEIGHT) -> DataFrame:
    """``src, dst, weight`` from ``host, html`` rows: links to other hosts, and both ways between a host
    and its parent domain (down to two labels). Links are summed per pair of hosts."""
    links = (pages.where("host <> ''")
             .select(F.col("host").alias("src"), F.explode(F.expr(
                 r"""transform(regexp_extract_all(html, '(?i)href\\s*=\\s*["\']?(?:https?:)?//([^/"\'?#\\s>]+)', 1),"""
                 r" h -> lower(h))")).alias("dst"))
             .where("src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight")))
    hosts = pages.where("host <> ''").select("host").union(links.select("dst")).distinct()
    chain = hosts.select(F.explode(F.expr(
        r"transform(sequence(0, greatest(size(split(host, '\\.')) - 2, 0)), i ->"
        r" array_join(slice(split(host, '\\.'), i + 1, size(split(host, '\\.'))), '.'))")).alias("host")).distinct()
    kin = (chain.select(F.col("host").alias("src"), F.expr(r"regexp_replace(host, '^[^.]*\\.', '')").alias("dst"))
           .where(r"size(split(src, '\\.')) > 2 AND dst <> ''"))
    kin = kin.union(kin.select("dst", "src")).withColumn("weight", F.lit(float(domain_weight)))
    return links.union(kin).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def host_scores(edges: DataFrame, seeds: DataFrame, *, damping: float = DAMPING, tolerance: float = TOLERANCE,
                iterations: int | None = None) -> DataFrame:
    """``host, trust, distrust`` from ``src, dst, weight`` edges and ``host, good, bad`` seed weights.

    Trust is PageRank personalised to the good seeds along the edges; distrust is PageRank personalised to
    the bad seeds against them. Hosts without a way on give their rank back to the seeds. Both walks take
    one join and one aggregate per iteration, in as many partitions as the edges need, until the summed change
    of both falls below ``tolerance`` (or for exactly ``iterations``, if given). Every iteration is checkpointed:
    its ranks are read twice, once for the change and the two sums that go back to the seeds.
    """
    ways = edges.groupBy("src").agg(F.sum("weight").alias("out"))
    back = edges.groupBy("dst").agg(F.sum("weight").alias("in"))
    e = edges.join(ways, "src").join(back, "dst")
    steps = settle(e.selectExpr("src AS host", "dst AS to", "weight / out AS f", "0D AS b")
                   .union(e.selectExpr("dst", "src", "0D", "weight / in"))
                   .groupBy("host", "to").agg(F.sum("f").alias("f"), F.sum("b").alias("b")))
    total = seeds.agg(F.sum("good").alias("g"), F.sum("bad").alias("d")).first()
    good, bad = total["g"] or 0.0, total["d"] or 0.0
    ends = steps.groupBy("host").agg(F.max("f").alias("f"), F.max("b").alias("b"))
    base = (seeds.groupBy("host").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
            .join(ends, "host", "full")
            .selectExpr("host", f"coalesce(good, 0D) / {good or 1.0}D AS s", f"coalesce(bad, 0D) / {bad or 1.0}D AS r",
                        "coalesce(f, 0D) = 0 AS stuck", "coalesce(b, 0D) = 0 AS start"))
    parts = -(-steps.count() // PARTITION_EDGES) or 1
    steps = settle(steps.coalesce(parts))
    ranks = settle(base.selectExpr(
        "host", "s", "r", "stuck", "start", "s AS trust", "r AS distrust", "1D AS change").coalesce(parts))
    done = 0
    while iterations is None or done < iterations:
        # a small graph is one partition, and then nothing in a round is shuffled
        ranks = ranks.coalesce(parts)
        told = ranks.agg(F.sum("change").alias("change"), F.sum(F.expr("CASE WHEN stuck THEN trust END")).alias("t"),
                         F.sum(F.expr("CASE WHEN start THEN distrust END")).alias("d")).first()
        if told["change"] is None or (iterations is None and done and told["change"] < tolerance):
            break
        moved = (ranks.join(steps, "host").selectExpr("to AS host", "trust * f AS t", "distrust * b AS d")
                 .coalesce(parts).groupBy("host").agg(F.sum("t").alias("t"), F.sum("d").alias("d")))
        ranks = settle(ranks.join(moved.coalesce(parts), "host", "left").selectExpr(
            "host", "s", "r", "stuck", "start", "trust AS old_trust", "distrust AS old_distrust",
            f"{1 - damping}D * s + {damping}D * (coalesce(t, 0D) + {told['t'] or 0.0!r}D * s) AS trust",
            f"{1 - damping}D * r + {damping}D * (coalesce(d, 0D) + {told['d'] or 0.0!r}D * r) AS distrust",
        ).selectExpr("host", "s", "r", "stuck", "start", "trust", "distrust",
                     "abs(trust - old_trust) + abs(distrust - old_distrust) AS change").coalesce(parts))
        done += 1
    return ranks.select("host", "trust", "distrust")


def judge_urls(pages: DataFrame, *, rules=RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
               threshold: float = THRESHOLD, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """``id, host, path, rule, verdict, trust, distrust`` for every row of ``pages``.

    Seeds are the hosts of pages that a rule decides, weighted by such pages. Pages without a rule are judged
    by their host: blocked if distrust / (trust + distrust), rounded to nine places, exceeds ``threshold``, with the
    ranks that both walks settle on (``TOLERANCE``).
    Hosts that neither walk reaches, and urls without a host, are allowed. Null and malformed urls have an
    empty host and path; null html has no links; null ids and repeated rows come back as they are (each adds
    to its host's seed weight); further columns are left out; an empty table gives no rows. ``rules`` is a
    short list: each is a branch of one expression.
    """
    read = pages.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{url_col}`").cast("string").alias("url"),
                        F.col(f"`{html_col}`").cast("string").alias("html"))
    placed = read.selectExpr("__id", f"{host_of('url')} AS host", f"{path_of('url')} AS path", "html")
    ruled = placed.select("*", F.expr(_first_fit(rules, lambda a, r: r)).alias("rule"),
                          F.expr(_first_fit(rules, lambda a, r: a)).alias("verdict"))
    seeds = settle(ruled.where("host <> ''").groupBy("host").agg(
        F.sum(F.expr("double(coalesce(verdict = 'allow', false))")).alias("good"),
        F.sum(F.expr("double(coalesce(verdict = 'block', false))")).alias("bad")))
    edges = settle(host_edges(placed.select("host", "html")))
    scores = settle(host_scores(edges, seeds, damping=damping, tolerance=tolerance))
    joined = ruled.drop("html").join(sized(scores), "host", "left")
    return joined.selectExpr(
        f"__id AS `{id_col}`", "host", "path", "rule",
        "coalesce(verdict, CASE WHEN trust + distrust > 0 AND"
        f" round(distrust / (trust + distrust), 9) > {threshold}D THEN 'block' ELSE 'allow' END) AS verdict",
        "trust", "distrust")
