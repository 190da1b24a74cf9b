"""URL filter by link-graph propagation: personalised PageRank from trusted seeds, reversed from blocked ones.

Hosts are the nodes. An edge weighs the links (href and src with a host of their own) from all pages of one host to
another; hosts of one registrable site are also tied to the site's own host both ways, with weight ``site_weight``.
Trust starts at the trusted seeds and follows the edges; distrust starts at the blocked seeds and follows them
backwards, so who links to a blocked host is distrusted. Each seed sends out a unit, so a score doesn't depend on the
number of seeds or hosts: it is the share of a seed's walks that end here, added over the seeds. What ``k`` rounds of
power iteration leave out is at most ``damping ** k`` of a unit a seed; as many are run as bring that below
``tolerance``. A host is dropped if it is a blocked seed, or if its distrust is at least ``least_distrust`` and at
least ``ratio`` times its trust.

Blocked seeds are the hosts that match ``blocked``. Trusted ones are those that match ``trusted``, and those that
``endorsed`` other sites or more link to; a list of hosts (a table with the column host) may be given for either
instead. Under the suffixes of ``suffixes`` others register names; any last label counts anyway.

Pages are read once for the links. Each round is one join on the hosts and one aggregation with partial sums on the
map side; every ``cut`` rounds the scores are written, which cuts the lineage. Nothing that grows with the corpus is
broadcast unchecked.

Defined cases: a null url, or one without a host, has a null host and null scores and is kept; a null or empty html
has no links, and a very long one is searched in one pass; links to the own host don't count; a host that is both
trusted and blocked counts as blocked; without seeds of a kind its scores are 0, as at a tie of distrust and
``ratio`` times trust the host goes; repeated pages count each time; an empty table gives no rows; other columns,
whatever their names, are ignored and page_id may be null.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetweave.llm._spark import Workspace, if_small

#: suffixes under which others register; a parameter, for such a list is a matter of the crawl
SUFFIXES = r"example\.com|example\.net|example\.org|co\.uk|ac\.uk|gov\.uk|com\.au|co\.jp|com\.br"
BLOCKED = r"(casino|cheap-pills|free-bets|spam-farm|ads-track|adult-x)"
TRUSTED = r"(\.(edu|gov|mil)|\.(ac|gov|edu)\.[a-z][a-z])$"
#: other sites that must link to a host to make it a trusted seed
ENDORSED = 5
DAMPING, TOLERANCE, CUT = 0.85, 1e-3, 8
SITE_WEIGHT, RATIO, LEAST_DISTRUST = 1.0, 1.0, 0.01

#: these two are read alike by Java and RE2
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#@]*@)?([^/?#:@]+)"
LINK = r"""[ \t\n\r](?:[hH][rR][eE][fF]|[sS][rR][cC])[ \t\n\r]*=[ \t\n\r]*["']?[ \t\n\r]*(?:[hH][tT][tT][pP][sS]?:)?//([^/"'<>?#:@ \t\n\r]+)"""


def site_pattern(suffixes: str = SUFFIXES) -> str:
    return rf"([^.]+\.({suffixes}|[^.]+))$"


def host_of(url: F.Column) -> F.Column:
    host = F.lower(F.regexp_extract(url, HOST, 2))
    return F.when(host != "", host)


def site_of(host: F.Column, suffixes: str = SUFFIXES) -> F.Column:
    site = F.regexp_extract(host, site_pattern(suffixes), 1)
    return F.when((site == "") | host.rlike(r"^[0-9.]+$"), host).otherwise(site)


def rounds_for(damping: float, tolerance: float) -> int:
    """Rounds after which what is still on its way is at most ``tolerance`` of a unit a seed."""
    return math.ceil(math.log(tolerance) / math.log(damping))


def edges_of(ws: Workspace, pages: DataFrame, suffixes: str = SUFFIXES, site_weight: float = SITE_WEIGHT) -> tuple[DataFrame, DataFrame]:
    """(links (src, dst, n), dst null for hosts without any; edges (src, dst, n) with the ties of sites). Both are written."""
    base = pages.select(host_of(F.col("url")).alias("src"), "html").where("src is not null")
    links = base.select("src", F.explode_outer(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("dst"))
    links = links.select("src", F.nullif(F.lower("dst"), F.col("src")).alias("dst")).groupBy("src", "dst").agg(F.count("*").cast("double").alias("n"))
    links = ws.write(links, "links")
    every = links.select(F.col("src").alias("host")).unionByName(links.where("dst is not null").select(F.col("dst").alias("host"))).distinct()
    ties = every.select("host", site_of(F.col("host"), suffixes).alias("site")).where("host <> site")
    ties = ties.selectExpr("host src", "site dst").unionByName(ties.selectExpr("site src", "host dst")).withColumn("n", F.lit(float(site_weight)))
    edges = links.where("dst is not null").unionByName(ties).groupBy("src", "dst").agg(F.sum("n").alias("n"))
    return links, ws.write(edges, "edges")


def host_scores(
    ws: Workspace, pages: DataFrame, trusted: str | DataFrame = TRUSTED, blocked: str | DataFrame = BLOCKED, suffixes: str = SUFFIXES, site_weight: float = SITE_WEIGHT, endorsed: int = ENDORSED,
    damping: float = DAMPING, tolerance: float = TOLERANCE, cut: int = CUT, ratio: float = RATIO, least_distrust: float = LEAST_DISTRUST,
) -> DataFrame:
    """(host, trust, distrust, blocked, keep) of each host that has a page or a link; a written table."""
    links, edges = edges_of(ws, pages, suffixes, site_weight)
    nodes = links.select(F.col("src").alias("host")).unionByName(edges.select(F.col("src").alias("host"))).unionByName(edges.select(F.col("dst").alias("host"))).distinct()
    sites = links.where("dst is not null").select("dst", site_of(F.col("src"), suffixes).alias("site")).where(F.col("site") != site_of(F.col("dst"), suffixes))
    known = sites.groupBy(F.col("dst").alias("host")).agg((F.count_distinct("site") >= endorsed).alias("known"))
    nodes = nodes.join(known, "host", "left")
    for name, rule in (("blocked", blocked), ("trusted", trusted)):
        if isinstance(rule, str):
            nodes = nodes.withColumn(name, F.col("host").rlike(rule) | (F.coalesce("known", F.lit(False)) if name == "trusted" else F.lit(False)))
        else:
            nodes = nodes.join(rule.select(F.lower("host").alias("host")).where("host is not null").distinct().withColumn(name, F.lit(True)), "host", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    nodes = ws.write(nodes.select("host", "blocked", "trusted"), "nodes")

    walks = edges.selectExpr("true up", "src frm", "dst to", "n").unionByName(edges.selectExpr("false up", "dst frm", "src to", "n"))
    total = walks.groupBy("up", "frm").agg(F.sum("n").alias("total"))
    walks = ws.write(walks.join(total, ["up", "frm"]).select("up", F.col("frm").alias("host"), "to", (F.col("n") / F.col("total") * damping).alias("w")), "walks")

    seeds = nodes.where("trusted and not blocked").selectExpr("true up", "host", f"1 - {damping}d x").unionByName(nodes.where("blocked").selectExpr("false up", "host", f"1 - {damping}d x"))
    now, last, rounds = seeds, None, rounds_for(damping, tolerance)
    for k in range(rounds):
        moved = now.join(walks, ["up", "host"]).select("up", F.col("to").alias("host"), (F.col("x") * F.col("w")).alias("x"))
        now = moved.unionByName(seeds).groupBy("up", "host").agg(F.sum("x").alias("x"))
        if (k + 1) % cut == 0 or k + 1 == rounds:
            now = ws.write(now, f"round{k}")
            if last is not None:
                ws.drop(last)
            last = f"round{k}"
    scores = now.groupBy("host").agg(*(F.coalesce(F.sum(F.expr(f"if(up = {side}, x, 0d)")), F.lit(0.0)).alias(name) for side, name in (("true", "trust"), ("false", "distrust"))))
    out = nodes.join(scores, "host", "left").select("host", *(F.round(F.coalesce(c, F.lit(0.0)), 9).alias(c) for c in ("trust", "distrust")), "blocked")
    out = out.withColumn("keep", F.expr(f"not (blocked or (distrust >= {least_distrust:.12f} and distrust >= {ratio:.12f} * trust))"))
    return ws.write(out, "scores", keep=True)


def url_filter(pages: DataFrame, **limits) -> DataFrame:
    """(page_id, host, trust, distrust, keep) of each page."""
    with Workspace(pages.sparkSession) as ws:
        scores = host_scores(ws, pages, **limits).drop("blocked")
        page = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"))
        scored = page.join(if_small(scores, 500_000), "host", "left")
    return scored.select("page_id", "host", "trust", "distrust", F.coalesce("keep", F.lit(True)).alias("keep"))


def sql(table: str = "pages") -> str:
    """The same in DuckDB, the rounds unrolled."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    host = f"nullif(lower(regexp_extract(url, {quote(HOST)}, 2)), '')"
    site = lambda h: f"(CASE WHEN regexp_extract({h}, {quote(site_pattern())}, 1) = '' OR regexp_matches({h}, '^[0-9.]+$') THEN {h} ELSE regexp_extract({h}, {quote(site_pattern())}, 1) END)"
    rounds = rounds_for(DAMPING, TOLERANCE)
    ctes = [
        f"base AS (SELECT page_id, {host} AS host, html FROM {table})",
        f"found AS (SELECT host AS src, lower(unnest(regexp_extract_all(html, {quote(LINK)}, 1))) AS dst FROM base WHERE host IS NOT NULL)",
        "links AS (SELECT src, dst, CAST(count(*) AS DOUBLE) AS n FROM found WHERE src <> dst GROUP BY 1, 2)",
        "every_host AS (SELECT host FROM base WHERE host IS NOT NULL UNION SELECT dst FROM links)",
        f"sites AS (SELECT host, {site('host')} AS site FROM every_host)",
        f"ties AS (SELECT host AS src, site AS dst, {SITE_WEIGHT} AS n FROM sites WHERE host <> site UNION ALL SELECT site, host, {SITE_WEIGHT} FROM sites WHERE host <> site)",
        "edges AS (SELECT src, dst, sum(n) AS n FROM (SELECT * FROM links UNION ALL SELECT * FROM ties) GROUP BY 1, 2)",
        f"known AS (SELECT dst AS host FROM links WHERE {site('src')} <> {site('dst')} GROUP BY 1 HAVING count(DISTINCT {site('src')}) >= {ENDORSED})",
        f"nodes AS (SELECT host, regexp_matches(host, {quote(BLOCKED)}) AS blocked, regexp_matches(host, {quote(TRUSTED)}) OR host IN (SELECT host FROM known) AS trusted FROM (SELECT host FROM every_host UNION SELECT src FROM edges UNION SELECT dst FROM edges))",
        "two_ways AS (SELECT true AS up, src AS frm, dst AS dest, n FROM edges UNION ALL SELECT false, dst, src, n FROM edges)",
        f"walks AS MATERIALIZED (SELECT up, frm, dest, n / sum(n) OVER (PARTITION BY up, frm) * {DAMPING} AS w FROM two_ways)",
        f"r0 AS MATERIALIZED (SELECT true AS up, host, 1 - {DAMPING}::DOUBLE AS x FROM nodes WHERE trusted AND NOT blocked UNION ALL SELECT false, host, 1 - {DAMPING}::DOUBLE FROM nodes WHERE blocked)",
    ]
    for k in range(rounds):
        ctes.append(f"r{k + 1} AS MATERIALIZED (SELECT up, host, sum(x) AS x FROM (SELECT s.up, dest AS host, x * w AS x FROM r{k} s JOIN walks v ON s.up = v.up AND s.host = v.frm UNION ALL SELECT up, host, x FROM r0) GROUP BY 1, 2)")
    ctes += [
        f"scores AS (SELECT host, blocked, round(coalesce(sum(CASE WHEN up THEN x ELSE 0 END), 0), 9) AS trust, round(coalesce(sum(CASE WHEN up THEN 0 ELSE x END), 0), 9) AS distrust FROM nodes LEFT JOIN r{rounds} USING (host) GROUP BY 1, 2)",
    ]
    return f"WITH {', '.join(ctes)} SELECT page_id, host, trust, distrust, coalesce(NOT (blocked OR (distrust >= {LEAST_DISTRUST:.12f}::DOUBLE AND distrust >= {RATIO} * trust)), true) AS keep FROM base LEFT JOIN scores USING (host)"
