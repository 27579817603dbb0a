"""URL filters by a path-template tree (operator 9), with DataFrame functions alone.

Per host, a path segment stays literal where enough pages have it, or enough pages of several hosts,
first at its depth and then below its own parent in the tree; it becomes a wildcard otherwise. Labels
are the verdicts of the rules. A branch whose labelled pages are blocked about as often as those of its
siblings (a test of two proportions) or that has none is merged with them: its pages are judged by the
next node above, on the same host and then on all hosts together. A node rejects where its purity, the
smoothed share of blocked pages, is high; unlabelled pages weigh against it.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.llm.common import cut, drop_cut, table

#: (verdict, rule): a host and a path prefix, as one string. A driver-side list, at most MAX_RULES.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
MAX_RULES = 1000
#: Pages of a literal segment, on its host or on so many hosts.
MIN_SUPPORT, MIN_HOSTS = 20, 3
#: Pseudo-labels, what an unlabelled page adds to them, the share of them that is blocked, the deviations
#: within which a branch is merged, the purity of a rejected template.
WEIGHT, UNLABELLED, PRIOR, SIMILAR, REJECT = 4.0, 0.05, 0.2, 2.0, 0.8


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty where url is null or has no ``://``."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def apply_rules(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls where none does. A rule fits its host and all subdomains."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for say, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        at, _, below = text.partition("/")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(f"/{below}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, say).otherwise(verdict)
    return rule, verdict


def _kept(counts: DataFrame, *node: str) -> DataFrame:
    """The nodes of (host, *node, n) that have enough pages on their host, or on several."""
    every = counts.groupBy(*node).agg(F.sum("n").alias("every"), F.count(F.lit(1)).alias("hosts"))
    enough = (F.col("n") >= MIN_SUPPORT) | ((F.col("every") >= MIN_SUPPORT) & (F.col("hosts") >= MIN_HOSTS))
    return counts.join(every, list(node)).where(enough).select("host", *node, F.lit(True).alias("literal"))


def _joined(each: DataFrame, kept: DataFrame, on: list[str], *of: str, out: str = "tokens") -> DataFrame:
    """The tokens by depth of each row of (*of, depth, seg): literal segments as they are, else wildcards."""
    token = F.when(F.col("literal"), F.col("seg")).otherwise("*")
    cell = F.when(F.col("seg").isNotNull(), F.struct("depth", token.alias("token")))
    found = each.join(kept, ["host", *on], "left").groupBy(*of).agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    return found.select(*of, F.transform("cells", lambda c: c["token"]).alias(out))


def _prefix(tokens: str, depth: Column | str) -> Column:
    return F.array_join(F.slice(tokens, 1, F.col(depth) if isinstance(depth, str) else depth), "/")


def path_templates(paths: DataFrame) -> DataFrame:
    """host, path, template of rows of host, path and n: segments joined by /, a wildcard for what
    varies, one for all that follows the last literal."""
    segs = F.filter(F.split("path", "/", -1), lambda x: x != "")
    each = paths.select("host", "path", "n", F.posexplode_outer(segs).alias("depth", "seg"))
    seen = each.where("seg is not null").groupBy("host", "depth", "seg").agg(F.sum("n").alias("n"))
    coarse = cut(_joined(each, _kept(seen, "depth", "seg"), ["depth", "seg"], "host", "path"))
    sums = coarse.join(paths, ["host", "path"]).groupBy("host", "tokens").agg(F.sum("n").alias("n"))
    nodes = sums.select("host", "tokens", "n", F.posexplode_outer("tokens").alias("depth", "seg")).withColumn("prefix", _prefix("tokens", F.col("depth") + 1))
    held = nodes.where("seg <> '*'").groupBy("host", "prefix").agg(F.sum("n").alias("n"))
    fine = _joined(nodes, _kept(held, "prefix"), ["prefix"], "host", "tokens", out="fine")
    last = F.coalesce(F.array_max(F.transform("fine", lambda t, i: F.when(t != "*", i + 1).otherwise(0))), F.lit(0))
    short = F.concat(F.slice("fine", 1, last), F.when(F.size("fine") > last, F.array(F.lit("*"))).otherwise(F.array().cast("array<string>")))
    return coarse.join(fine.select("host", "tokens", F.array_join(short, "/").alias("template")), ["host", "tokens"]).select("host", "path", "template")


def _purity(nodes: DataFrame, up: DataFrame, on: list[str]) -> DataFrame:
    """Adds to nodes (prefix, parent, n, bad, labelled) purity, null where the node is merged."""
    smooth = lambda bad, n: (bad + F.lit(WEIGHT * PRIOR)) / (n + F.lit(WEIGHT))
    above = up.select(*on, F.col("prefix").alias("parent"), F.col("bad").alias("all_bad"), F.col("labelled").alias("all_labelled"))
    rows = nodes.join(above, [*on, "parent"], "left")
    bad, n, o_bad, o_n = F.col("bad"), F.col("labelled"), F.col("all_bad") - F.col("bad"), F.col("all_labelled") - F.col("labelled")
    both = smooth(F.col("all_bad"), F.col("all_labelled"))
    apart = F.abs(smooth(bad, n) - smooth(o_bad, o_n)) > F.lit(SIMILAR) * F.sqrt(both * (F.lit(1.0) - both) * (F.lit(1.0) / (n + F.lit(WEIGHT)) + F.lit(1.0) / (o_n + F.lit(WEIGHT))))
    own = (n > 0) & (F.col("depth") == 0) | (n > 0) & ((o_n == 0) | apart)
    weight = F.lit(WEIGHT) + F.lit(UNLABELLED) * (F.col("n") - n)
    return rows.select(*on, "prefix", F.when(own, (bad + F.lit(PRIOR) * weight) / (n + weight)).alias("purity"))


def judge_templates(templates: DataFrame) -> DataFrame:
    """host, template, learned of rows of host, template, n, bad, labelled."""
    tokens = F.filter(F.split("template", "/", -1), lambda x: x != "")
    each = templates.withColumn("tokens", tokens).select("*", F.explode(F.sequence(F.lit(0), F.size("tokens"))).alias("depth"))
    each = each.withColumn("prefix", _prefix("tokens", "depth")).withColumn("parent", F.when(F.col("depth") > 0, _prefix("tokens", F.col("depth") - 1)))
    sums = lambda df, *of: df.groupBy(*of, "prefix", "parent", "depth").agg(*[F.sum(c).alias(c) for c in ("n", "bad", "labelled")])
    here = sums(each, "host")
    every = sums(here)
    own, shared = _purity(here, here, ["host"]), _purity(every, every, [])
    asked = each.select("host", "template", "depth", "prefix").join(own, ["host", "prefix"]).join(shared.withColumnRenamed("purity", "shared"), "prefix")
    found = asked.groupBy("host", "template").agg(F.max(F.when(F.coalesce("purity", "shared").isNotNull(), F.struct("depth", F.coalesce("purity", "shared").alias("purity")))).alias("node"))
    return found.select("host", "template", F.when(F.col("node.purity") >= REJECT, "block").otherwise("allow").alias("learned"))


def judge_urls(pages: DataFrame, url: str = "url", key: str = "page_id", rules: tuple = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template of every row, null and repeated ones too.

    Labels are the rules' own verdicts. Pages without a rule are judged by the deepest node of their
    template that is not merged, on their host before all hosts; without any label all are allowed.
    Null urls and those without ``://`` have an empty host and path and are one branch. Empty tables
    give no rows; other columns are ignored.
    """
    host, path = split_url(F.col(url))
    rows = pages.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = apply_rules(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("ruled", verdict)
    paths = cut(rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ruled") == "block").alias("bad"), F.count("ruled").alias("labelled")))
    named = cut(path_templates(paths))
    sums = cut(named.join(paths, ["host", "path"]).groupBy("host", "template").agg(*[F.sum(c).alias(c) for c in ("n", "bad", "labelled")]))
    told = cut(named.join(judge_templates(sums), ["host", "template"]))
    for done in (paths, named, sums):
        drop_cut(done)
    return rows.join(told, ["host", "path"]).select("page_id", "host", "path", "rule", F.coalesce("ruled", "learned").alias("verdict"), "template")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """judge_urls() of all pages: a row for every row; nulls, ties, repeats and empty tables as there."""
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"))


def _sql_rules(what: int) -> str:
    cases = []
    for say, text in sorted(RULES, key=lambda r: (len(r[1]), r[1]), reverse=True):
        at, _, below = text.partition("/")
        cases.append(f"WHEN (host = '{at}' OR suffix(host, '.{at}')) AND starts_with(path, '/{below}') THEN '{(say, text)[what]}'")
    return f"CASE {' '.join(cases)} END"


def _sql_smooth(bad: str, n: str) -> str:
    return f"(({bad}) + {WEIGHT * PRIOR}::DOUBLE) / (({n}) + {WEIGHT}::DOUBLE)"


def _sql_purity(nodes: str, on: str) -> str:
    both = _sql_smooth("u.bad", "u.labelled")
    apart = f"abs({_sql_smooth('x.bad', 'x.labelled')} - {_sql_smooth('u.bad - x.bad', 'u.labelled - x.labelled')}) > {SIMILAR}::DOUBLE * sqrt({both} * (1.0::DOUBLE - {both}) * (1.0::DOUBLE / (x.labelled + {WEIGHT}::DOUBLE) + 1.0::DOUBLE / (u.labelled - x.labelled + {WEIGHT}::DOUBLE)))"
    weight = f"({WEIGHT}::DOUBLE + {UNLABELLED}::DOUBLE * (x.n - x.labelled))"
    host = "x.host, " if on else ""
    return f"""SELECT {host}x.prefix, CASE WHEN x.labelled > 0 AND (x.depth = 0 OR u.labelled = x.labelled OR {apart})
  THEN (x.bad + {PRIOR}::DOUBLE * {weight}) / (x.labelled + {weight}) END AS purity
  FROM {nodes} x LEFT JOIN {nodes} u ON {on}u.prefix = x.parent AND u.depth = x.depth - 1"""


SQL = {
    "op9_url_filter": f"""
WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
s AS (SELECT page_id, host, path, {_sql_rules(1)} AS rule, {_sql_rules(0)} AS ruled FROM u),
p AS (SELECT host, path, count(*) AS n, count(*) FILTER (WHERE ruled = 'block') AS bad, count(ruled) AS labelled,
  list_filter(string_split(path, '/'), lambda x: x <> '') AS segs FROM s GROUP BY host, path),
e AS (SELECT host, path, n, i AS depth, segs[i] AS seg FROM (SELECT host, path, n, segs, unnest(range(1, len(segs) + 1)) AS i FROM p)),
f AS (SELECT host, depth, seg, sum(n) AS n FROM e GROUP BY host, depth, seg),
k AS (SELECT host, depth, seg FROM (SELECT host, depth, seg, n, sum(n) OVER (PARTITION BY depth, seg) AS every, count(*) OVER (PARTITION BY depth, seg) AS hosts FROM f)
  WHERE n >= {MIN_SUPPORT} OR (every >= {MIN_SUPPORT} AND hosts >= {MIN_HOSTS})),
c AS (SELECT p.host, p.path, p.n, p.bad, p.labelled, coalesce(t.tokens, []) AS tokens FROM p LEFT JOIN
  (SELECT e.host, e.path, list(CASE WHEN k.seg IS NULL THEN '*' ELSE e.seg END ORDER BY e.depth) AS tokens FROM e LEFT JOIN k ON e.host = k.host AND e.depth = k.depth AND e.seg = k.seg GROUP BY e.host, e.path) t
  ON p.host = t.host AND p.path = t.path),
d AS (SELECT host, tokens, n, i AS depth, tokens[i] AS seg, array_to_string(tokens[1:i], '/') AS prefix FROM (SELECT host, tokens, n, unnest(range(1, len(tokens) + 1)) AS i FROM c)),
h AS (SELECT host, prefix, sum(n) AS n FROM d WHERE seg <> '*' GROUP BY host, prefix),
g AS (SELECT host, prefix FROM (SELECT host, prefix, n, sum(n) OVER (PARTITION BY prefix) AS every, count(*) OVER (PARTITION BY prefix) AS hosts FROM h)
  WHERE n >= {MIN_SUPPORT} OR (every >= {MIN_SUPPORT} AND hosts >= {MIN_HOSTS})),
o AS (SELECT host, tokens, list(token ORDER BY depth) AS fine FROM (SELECT DISTINCT d.host, d.tokens, d.depth, CASE WHEN g.prefix IS NULL THEN '*' ELSE d.seg END AS token FROM d LEFT JOIN g ON d.host = g.host AND d.prefix = g.prefix) GROUP BY host, tokens),
l AS (SELECT host, tokens, fine, coalesce(list_max(list_transform(fine, lambda x, i: CASE WHEN x <> '*' THEN i ELSE 0 END)), 0) AS last FROM o),
m AS (SELECT c.host, c.path, c.n, c.bad, c.labelled, coalesce(list_concat(l.fine[1:l.last], CASE WHEN len(l.fine) > l.last THEN ['*'] ELSE [] END), []) AS fine FROM c LEFT JOIN l ON c.host = l.host AND c.tokens = l.tokens),
a AS (SELECT host, path, n, bad, labelled, fine, i AS depth, coalesce(array_to_string(fine[1:i], '/'), '') AS prefix, CASE WHEN i > 0 THEN coalesce(array_to_string(fine[1:i - 1], '/'), '') END AS parent
  FROM (SELECT *, unnest(range(0, len(fine) + 1)) AS i FROM m)),
nh AS (SELECT host, prefix, parent, depth, sum(n) AS n, sum(bad) AS bad, sum(labelled) AS labelled FROM a GROUP BY host, prefix, parent, depth),
ne AS (SELECT prefix, parent, depth, sum(n) AS n, sum(bad) AS bad, sum(labelled) AS labelled FROM nh GROUP BY prefix, parent, depth),
ph AS ({_sql_purity("nh", "u.host = x.host AND ")}),
pe AS ({_sql_purity("ne", "")}),
j AS (SELECT a.host, a.path, arg_max(coalesce(ph.purity, pe.purity), a.depth) FILTER (WHERE coalesce(ph.purity, pe.purity) IS NOT NULL) AS purity, any_value(coalesce(array_to_string(a.fine, '/'), '')) AS template
  FROM a JOIN ph ON a.host = ph.host AND a.prefix = ph.prefix JOIN pe ON a.prefix = pe.prefix GROUP BY a.host, a.path)
SELECT page_id, s.host, s.path, rule, coalesce(ruled, CASE WHEN purity >= {REJECT}::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict, template FROM s JOIN j ON s.host = j.host AND s.path = j.path"""
}
QUERIES = {"op9_url_filter": op9_url_filter}
