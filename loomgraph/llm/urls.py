"""URL filters with redirect equivalence (DataFrame functions only).

A rule (host, path, verdict) fits its host and all subdomains where the URL's path starts with the rule's path; the
longest rule wins, an allow wins a tie. Rules are a table: the suffixes of each distinct host are joined with it, so
any number of rules costs one join and no expression grows. URLs that redirect to one another or name the same
canonical page form one component. A URL without a rule of its own is judged by its component: allow if any member is
explicitly allowed, else block if any member is blocked, else allow. A URL with a rule keeps the rule's verdict.

Edges are read from the pages (``<link rel=canonical>``, ``<meta http-equiv=refresh>``) and from an optional table
of redirects. Nodes are host + path + query: scheme and fragment do not tell pages apart. Hosts and components may be
hot; both are joined by :func:`loomgraph.functions.skew.join_by_count`.

Defined cases: a null URL or one without ``://`` has empty host and path, no rule, no edges; a null html has no
edges; repeated rows are judged alike; an empty table gives an empty result; input columns with the name of an
output column (and html) are replaced, all others pass through; very long html is scanned whole; a rule whose host,
path or verdict is null fits nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.columns import quoted, unused
from loomgraph.functions.fixpoint import connected_components
from loomgraph.functions.skew import join_by_count
from loomgraph.functions.storage import discard, stash

#: (host, path, verdict)
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
RULE = "host string, path string, verdict string"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK_TAG = r"(?i)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
META_TAG = r"(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
HREF = r"(?i)\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))"
REFRESH = r"(?i)\burl\s*=\s*[\"']?([^\"'>\s;]+)"


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """host + path + query; null where there is no host."""
    query = F.coalesce(F.regexp_extract(_rest(url), r"^[^?#]*(\?[^#]*)", 1), F.lit(""))
    host = host_of(url)
    return F.when(host != "", F.concat(host, F.when(path_of(url) == "", F.lit("/")).otherwise(path_of(url)), query))


def rule_table(spark, rules) -> DataFrame:
    """Rules as (host, path, verdict): a table, or a list of such rows."""
    return rules.select("host", "path", "verdict") if isinstance(rules, DataFrame) else spark.createDataFrame(list(rules), RULE)


def suffixes(host: Column) -> Column:
    """The host and its parent domains."""
    parts = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, n, rules): for each of the distinct ``hosts`` (host, n) that has any, the rules of its suffixes."""
    told = rules.where("host is not null and path is not null and verdict is not null").groupBy(F.col("host").alias("at")).agg(
        F.collect_set(
            F.struct(
                F.length(F.concat("host", "path")).alias("n"), (F.col("verdict") == "allow").cast("int").alias("allow"),
                F.concat("host", "path").alias("rule"), "verdict", "path",
            )
        ).alias("rules")
    )
    spread = hosts.select("host", "n", F.explode(suffixes(F.col("host"))).alias("at"))
    return spread.join(told, "at").groupBy("host").agg(F.first("n").alias("n"), F.flatten(F.collect_list("rules")).alias("rules"))


def with_rule(rows: DataFrame, rules: DataFrame, host: str, path: str, name: str) -> DataFrame:
    """``rows`` plus the longest fitting rule as struct(n, allow, rule, verdict, path), or null, in ``name``. The column
    ``host`` has no nulls."""
    counts = stash(rows.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("n")), "hosts")
    known = host_rules(counts, rules)
    # every host has a row here, so no page is lost in the join
    full = stash(counts.join(known.drop("n"), "host", "left").select(F.col("host").alias(host), "n", F.col("rules").alias(name)), "hostrules")
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    count, = unused(rows.columns, "n")
    joined = join_by_count(rows, full.withColumnRenamed("n", count), [host], total, count)
    return joined.withColumn(name, F.array_max(F.filter(F.col(name), lambda r: F.col(path).startswith(r["path"]))))


def resolve(base: Column, target: Column) -> Column:
    """Absolute form of a link target on the page ``base``; null for an empty one."""
    t = F.trim(F.regexp_replace(target, "&amp;", "&"))
    scheme = F.regexp_extract(base, r"^([^:/?#]*)://", 1)
    root = F.concat(scheme, F.lit("://"), host_of(base))
    folder = F.regexp_replace(path_of(base), r"[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    return (
        F.when(t == "", F.lit(None).cast("string"))
        .when(F.locate("://", t) > 0, t)
        .when(t.startswith("//"), F.concat(scheme, F.lit(":"), t))
        .when(t.startswith("/"), F.concat(root, t))
        .when(t.startswith("?"), F.concat(root, path_of(base), t))
        .when(t.startswith("#"), base)
        .otherwise(F.concat(root, folder, t))
    )


def page_edges(pages: DataFrame) -> DataFrame:
    """(src, dst) nodes of canonical links and refresh redirects that the pages name."""
    links = F.transform(
        F.regexp_extract_all("html", F.lit(LINK_TAG), F.lit(0)),
        lambda tag: F.concat(*[F.regexp_extract(tag, HREF, k) for k in (1, 2, 3)]),
    )
    moves = F.transform(F.regexp_extract_all("html", F.lit(META_TAG), F.lit(0)), lambda tag: F.regexp_extract(tag, REFRESH, 1))
    tagged = pages.where(F.col("html").rlike(r"(?i)\bcanonical\b|http-equiv")).select(
        "url", F.explode(F.concat(links, moves)).alias("target")
    )
    return tagged.select(node_of(F.col("url")).alias("src"), node_of(resolve(F.col("url"), F.col("target"))).alias("dst"))


def spread_verdicts(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """(node, spread): for every node of the edges the decision of its component, null where no member has a rule."""
    comps = connected_components(edges.where("src is not null and dst is not null and src <> dst"))
    as_url = F.concat(F.lit("x://"), F.col("node"))  # a node is its own URL without the scheme
    named = comps.select("node", "component", host_of(as_url).alias("host"), path_of(as_url).alias("path"))
    ruled = stash(with_rule(named, rules, "host", "path", "best").select("node", "component", F.col("best.verdict").alias("own")), "ruled")
    said = stash(
        ruled.groupBy("component").agg(
            F.max((F.col("own") == "allow").cast("int")).alias("any_allow"),
            F.max((F.col("own") == "block").cast("int")).alias("any_block"),
            F.count(F.lit(1)).alias("n"),
        ).select("component", "n", F.when(F.col("any_allow") == 1, "allow").when(F.col("any_block") == 1, "block").alias("spread")),
        "said",
    )
    out = stash(join_by_count(ruled, said, ["component"], ruled.count()).select("node", "spread"), "spread")
    discard(ruled, said)
    return out


def judge(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """All columns of ``pages`` but html, plus host, path, rule, verdict. ``redirects``: (src_url, dst_url)."""
    told = rule_table(pages.sparkSession, rules)
    edges = page_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(
            redirects.select(node_of(F.col("src_url")).alias("src"), node_of(F.col("dst_url")).alias("dst"))
        )
    made = ("host", "path", "rule", "verdict", "html")
    rest = [c for c in pages.columns if c.lower() not in made]
    host, path, node, best, spread = unused([*pages.columns, *made], "h", "p", "node", "best", "spread")
    url = F.col("url")
    known = pages.select(*quoted(rest), host_of(url).alias(host), path_of(url).alias(path), node_of(url).alias(node))
    alias = spread_verdicts(edges, told).select(F.col("node").alias(node), F.col("spread").alias(spread))
    # an alias table has one row for each node; pages of one node share its row, which AQE copies if the node is hot
    joined = with_rule(known, told, host, path, best).join(alias, node, "left")
    return joined.select(
        *quoted(rest), F.col(host).alias("host"), F.col(path).alias("path"), F.col(best)["rule"].alias("rule"),
        F.coalesce(F.col(best)["verdict"], F.col(spread), F.lit("allow")).alias("verdict"),
    )


def op7(spark, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")


#: Edges, components (as the nodes that each node reaches) and their decisions, beside the rules.
OP7_SQL = r"""
WITH RECURSIVE u AS (SELECT page_id, url, html, coalesce(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3)
    ELSE '' END, '') AS rest FROM pages),
h AS (SELECT page_id, url, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
    regexp_extract(rest, '^[^?#]*(\?[^#]*)', 1) AS query FROM u),
n AS (SELECT *, CASE WHEN host <> '' THEN host || CASE WHEN path = '' THEN '/' ELSE path END || query END AS node FROM h),
t AS (SELECT url, host, path, node, trim(replace(unnest(
    list_transform(regexp_extract_all(html, '(?i)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), lambda x:
        regexp_extract(x, '(?i)\bhref\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s>"'']+))', 1)
        || regexp_extract(x, '(?i)\bhref\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s>"'']+))', 2)
        || regexp_extract(x, '(?i)\bhref\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s>"'']+))', 3))
    || list_transform(regexp_extract_all(html, '(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), lambda x:
        regexp_extract(x, '(?i)\burl\s*=\s*["'']?([^"''>\s;]+)', 1))), '&amp;', '&'), ' ') AS t FROM n),
s AS (SELECT *, regexp_extract(url, '^([^:/?#]*)://', 1) AS scheme, CASE WHEN regexp_replace(path, '[^/]*$', '') = '' THEN '/'
    ELSE regexp_replace(path, '[^/]*$', '') END AS folder FROM t),
a AS (SELECT node AS src, CASE WHEN t = '' THEN NULL WHEN strpos(t, '://') > 0 THEN t WHEN starts_with(t, '//') THEN scheme || ':' || t
    WHEN starts_with(t, '/') THEN scheme || '://' || host || t WHEN starts_with(t, '?') THEN scheme || '://' || host || path || t
    WHEN starts_with(t, '#') THEN url ELSE scheme || '://' || host || folder || t END AS target FROM s),
b AS (SELECT src, CASE WHEN strpos(target, '://') > 0 THEN substr(target, strpos(target, '://') + 3) ELSE '' END AS rest FROM a
    WHERE src IS NOT NULL AND target IS NOT NULL),
c AS (SELECT src, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*(\?[^#]*)', 1) AS query FROM b),
e0 AS (SELECT src, host || CASE WHEN path = '' THEN '/' ELSE path END || query AS dst FROM c WHERE host <> ''),
e AS (SELECT src, dst FROM e0 WHERE src <> dst UNION SELECT dst, src FROM e0 WHERE src <> dst),
g(node, other) AS (SELECT src, src FROM e UNION SELECT g.node, e.dst FROM g JOIN e ON g.other = e.src),
r(rh, rp, rv) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
    ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
o AS (SELECT other, (SELECT max({'n': length(rh) + length(rp), 'a': (rv = 'allow')::INT, 'rule': rh || rp, 'v': rv}) FROM r
    WHERE (regexp_extract(other, '^([^/?#]*)', 1) = rh OR ends_with(regexp_extract(other, '^([^/?#]*)', 1), '.' || rh))
    AND starts_with(regexp_extract(other, '^[^/?#]*([^?#]*)', 1), rp)).v AS own FROM (SELECT DISTINCT other FROM g)),
v AS (SELECT node, CASE WHEN bool_or(own = 'allow') THEN 'allow' WHEN bool_or(own = 'block') THEN 'block' END AS spread
    FROM g JOIN o USING (other) GROUP BY node),
m AS (SELECT n.*, (SELECT max({'n': length(rh) + length(rp), 'a': (rv = 'allow')::INT, 'rule': rh || rp, 'v': rv})
    FROM r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS best FROM n)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.v, spread, 'allow') AS verdict FROM m LEFT JOIN v USING (node)
"""
