"""URL filter by a path-template tree, in DataFrame functions alone.

Rules label urls; what they say of a few urls of a host is carried over to the others by templates:

1. Per host, a path's segments are nodes of a tree; a node is told by host and the shapes of the segments before it (letters are a,
   digits are 0). A value that a node sees often is a literal branch, any other one is variable and becomes a wildcard of its shape.
2. Sibling branches are merged where they are statistically alike: the templates below a branch against those below all its siblings
   (chi-squared), and likewise the labels, both at the 1 % level. Each branch is compared with the pool, so no pairs are formed.
3. A merged template's share of blocked urls is smoothed by its host's, that by the site's (last two labels of the host), that by the
   share of all labelled urls. A template at REJECT or more is rejected. A rule that fits a url wins over its template.

Urls are counted by host and path before anything is shuffled; joins deal a key with more than a 256th of the rows to several tasks.
A path has DEPTH segments at most, the last one being all the rest, whole. A null url and one without ``://`` have an empty host and an
empty path, and share the template of those. Repeated rows count as often as they occur and each give a row. Null page ids and
other columns change nothing. An empty table gives no rows.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotline.llm.common import keep

DEPTH = 6
#: A literal branch has so many urls at least, and at least one in BRANCHES of its node's urls.
LEAST, BRANCHES = 5, 32
#: Labelled urls that a smoothing prior counts for, and the share of blocked ones at which a template is rejected.
PRIOR, REJECT = 4.0, 0.6
#: The 99 % points of the standard normal and of chi-squared with one degree of freedom.
NORMAL_99, CHI_99 = 2.326347874, 6.634896601
#: A key with more than one in PIECES of the rows of a join is dealt to several tasks.
PIECES = 256


@dataclass(frozen=True)
class Rule:
    """``verdict host/path``: fits the host and its subdomains where the path starts alike."""

    verdict: str
    text: str

    @classmethod
    def of(cls, line: str) -> Rule:
        verdict, text = line.split()
        if verdict not in ("allow", "block") or "/" not in text:
            raise ValueError(f"not a rule: {line}")
        return cls(verdict, text)

    def fits(self, host: Column, path: Column) -> Column:
        name, _, rest = self.text.partition("/")
        return ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")


#: Fixed values of the contract.
RULES = ("allow org/", "block example.org/es/", "block example.org/en/1", "allow com/fr/", "block com/de/")


def longest_rule(rules: Sequence[str], host: Column, path: Column) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits (equal lengths: the first one listed), null where none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(map(Rule.of, reversed(rules)), key=lambda r: len(r.text)):
        text, verdict = (F.when(rule.fits(host, path), F.lit(mine)).otherwise(other) for mine, other in ((rule.text, text), (rule.verdict, verdict)))
    return text, verdict


def located(pages: DataFrame) -> DataFrame:
    """page_id, host, path."""
    url = F.coalesce(F.col("url"), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1).alias("path"))


def dealt_join(rows: DataFrame, keyed: DataFrame, keys: list[str], size: str, how: str = "inner") -> DataFrame:
    """Join ``rows`` to ``keyed``, which has one row a key and in ``size`` the number of rows that it meets.

    Both are read from files. Keys with more than a 256th of all rows, so fewer than 256 of them, are broadcast with their number of
    pieces; their rows are dealt to the pieces in turn, and ``keyed`` has a row for each piece.
    """
    total = keyed.agg(F.sum(size)).first()[0] or 0
    pieces = F.ceil(F.col(size) * PIECES / F.lit(max(1, total))).cast("int")
    hot = keyed.where(F.col(size) * PIECES > total).select(*keys, pieces.alias("__pieces"))
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("__piece", F.pmod(F.monotonically_increasing_id(), F.coalesce("__pieces", F.lit(1))).cast("int"))
    spread = F.sequence(F.lit(0), F.when(F.col(size) * PIECES > total, pieces - 1).otherwise(0))
    return dealt.drop("__pieces").join(keyed.withColumn("__piece", F.explode(spread)), [*keys, "__piece"], how).drop("__piece")


def shape(segment: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(segment, r"\p{L}+", "a"), "[0-9]+", "0")


def chi_limit(df: Column) -> Column:
    """The 99 % point of chi-squared (Wilson and Hilferty's cube)."""
    part = F.lit(2.0) / (F.lit(9.0) * df)
    return df * F.pow(F.lit(1.0) - part + F.lit(NORMAL_99) * F.sqrt(part), F.lit(3.0))


def generalised(paths: DataFrame) -> DataFrame:
    """``paths`` (host, path, n, ...) with labels: literal segments and wildcards; written to the shared folder."""
    segments = F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(F.split(F.substring("path", 2, 1 << 30), "/", DEPTH))
    shaped = paths.withColumn("segments", segments).withColumn("shapes", F.transform("segments", shape))
    steps = F.transform("segments", lambda s, i: F.struct(i.alias("depth"), F.array_join(F.slice("shapes", 1, i), "/").alias("above"), s.alias("segment"), F.get("shapes", i).alias("shape")))
    nodes = keep(shaped.select("host", "path", "n", F.explode(steps).alias("s")).select("host", "path", "n", "s.*"))
    node, value = ["host", "depth", "above"], ["host", "depth", "above", "segment"]
    values = nodes.groupBy(*value).agg(F.sum("n").alias("n"), F.count("*").alias("rows"))
    often = keep(values.where(F.col("n") >= LEAST))
    totals = nodes.groupBy(*node).agg(F.sum("n").alias("total"))
    sizes = often.groupBy(*node).agg(F.count("*").alias("values"))
    totals = keep(sizes.join(totals, node))
    literal = dealt_join(often, totals, node, "values").where(F.col("n") * BRANCHES >= F.col("total")).select(*value, "rows")
    known = dealt_join(nodes.drop("n"), keep(literal), value, "rows", "left")
    label = F.when(F.col("rows").isNotNull(), F.col("segment")).otherwise(F.concat(F.lit("{"), F.col("shape"), F.lit("}")))
    named = known.groupBy("host", "path").agg(F.sort_array(F.collect_list(F.struct("depth", label.alias("label")))).alias("steps"))
    named = named.select("host", "path", F.array_join(F.col("steps.label"), "/").alias("template"), F.col("steps.label").alias("labels"))
    whole = paths.join(named, ["host", "path"], "left")
    return keep(whole.withColumns({"template": F.coalesce("template", F.lit("")), "labels": F.coalesce("labels", F.array().cast("array<string>"))}))


def merged(templates: DataFrame) -> DataFrame:
    """host, template and the template with merged branches as (*): templates have n, allowed, blocked and labels."""
    size = F.size("labels")
    cuts = F.transform("labels", lambda b, i: F.struct(i.alias("depth"), F.array_join(F.slice("labels", 1, i), "/").alias("above"), b.alias("branch"), F.array_join(F.slice("labels", i + 2, size), "/").alias("below")))
    cells = templates.select("host", "template", "n", "allowed", "blocked", F.explode(cuts).alias("c")).select("host", "template", "n", "allowed", "blocked", "c.*")
    node, branch = ["host", "depth", "above"], ["host", "depth", "above", "branch"]
    below = cells.groupBy(*node, "below").agg(F.sum("n").alias("same"))
    parts = cells.join(below, [*node, "below"]).groupBy(*branch).agg(
        F.sum("n").alias("n"), F.sum("allowed").alias("a"), F.sum("blocked").alias("b"), F.sum(F.col("n") * F.col("n") / F.col("same")).alias("squares"))
    pool = below.groupBy(*node).agg(F.sum("same").alias("all"), F.count("*").alias("kinds"))
    labels = cells.groupBy(*node).agg(F.sum("allowed").alias("pa"), F.sum("blocked").alias("pb"))
    met = parts.join(pool, node).join(labels, node)
    n, all_ = F.col("n").cast("double"), F.col("all").cast("double")
    spread = (all_ / n * F.col("squares") - n) / (F.lit(1.0) - n / all_)
    df = (F.col("kinds") - 1).cast("double")
    some, whole = (F.col("a") + F.col("b")).cast("double"), (F.col("pa") + F.col("pb")).cast("double")
    share = F.col("pb") / whole
    gap = F.col("b") - some * share
    odd = gap * gap / (some * share * (F.lit(1.0) - share) * (F.lit(1.0) - some / whole))
    told = (some > 0) & (some < whole) & (F.col("pa") > 0) & (F.col("pb") > 0)
    alike = (F.col("n") < F.col("all")) & ((df == 0) | F.when(df > 0, spread <= chi_limit(df))) & F.when(told, odd <= CHI_99).otherwise(True)
    flags = met.select(*branch, F.coalesce(alike, F.lit(False)).alias("alike"))
    step = F.struct("depth", F.when(F.col("alike"), F.lit("(*)")).otherwise(F.col("branch")).alias("label"))
    back = cells.select("template", *branch).join(flags, branch).groupBy("host", "template").agg(F.sort_array(F.collect_list(step)).alias("steps"))
    return back.select("host", "template", F.array_join(F.col("steps.label"), "/").alias("merged"))


def smoothed(templates: DataFrame) -> DataFrame:
    """host, merged, blocked_share of templates with merged, allowed, blocked."""
    site = F.regexp_extract("host", r"([^.]*\.)?[^.]*$", 0)
    sums = [F.sum("allowed").alias("a"), F.sum("blocked").alias("b")]

    def share(above: Column) -> Column:
        return (F.col("b") + F.lit(PRIOR) * above) / (F.col("a") + F.col("b") + F.lit(PRIOR))

    leaves = templates.groupBy("host", "merged").agg(*sums)
    hosts = leaves.groupBy("host").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).withColumn("site", site)
    sites = hosts.groupBy("site").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    root = sites.agg(((F.sum("b") + F.lit(1.0)) / (F.sum("a") + F.sum("b") + F.lit(2.0))).alias("p")).scalar()
    sites = sites.select("site", share(root).alias("site_share"))
    hosts = hosts.join(sites, "site").select("host", share(F.col("site_share")).alias("host_share"))
    return leaves.join(hosts, "host").select("host", "merged", share(F.col("host_share")).alias("blocked_share"))


def judge(pages: DataFrame, rules: Sequence[str] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block), template of every row of page_id and url."""
    source = located(pages)
    paths = source.groupBy("host", "path").agg(F.count("*").alias("n"))
    rule, says = longest_rule(rules, F.col("host"), F.col("path"))
    paths = paths.withColumns({"rule": rule, "says": says})
    paths = keep(paths.withColumns({"allowed": F.when(says == "allow", F.col("n")).otherwise(0), "blocked": F.when(says == "block", F.col("n")).otherwise(0)}))
    named = generalised(paths)
    templates = keep(named.groupBy("host", "template", "labels").agg(*[F.sum(c).alias(c) for c in ("n", "allowed", "blocked")], F.count("*").alias("paths")))
    together = templates.join(merged(templates), ["host", "template"], "left").withColumn("merged", F.coalesce("merged", "template"))
    together = keep(together.select("host", "template", "merged", "allowed", "blocked", "paths"))
    shares = together.join(smoothed(together), ["host", "merged"]).select("host", "template", "merged", "blocked_share", "paths")
    judged = dealt_join(named.select("host", "path", "n", "rule", "says", "template"), keep(shares), ["host", "template"], "paths")
    verdict = F.coalesce("says", F.when(F.col("blocked_share") >= REJECT, F.lit("block")).otherwise("allow"))
    judged = keep(judged.select("host", "path", "n", "rule", verdict.alias("verdict"), F.col("merged").alias("template")))
    return dealt_join(source, judged, ["host", "path"], "n").select("page_id", "host", "path", "rule", "verdict", "template")


#: The same rows by window sums.
SQL = r"""
WITH u AS (SELECT CAST(page_id AS BIGINT) page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END r FROM pages),
s AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) path FROM u),
rules(verdict, rh, rp) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
d AS (SELECT host, path, count(*) n FROM s GROUP BY ALL),
p AS (SELECT d.*, x.rule, x.says FROM d LEFT JOIN (SELECT host, path, arg_max(rh || rp, length(rh || rp)) rule, arg_max(verdict, length(rh || rp)) says
  FROM d JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY ALL) x USING (host, path)),
parts AS (SELECT *, CASE WHEN path = '' THEN [] ELSE string_split(substr(path, 2), '/') END all_parts FROM p),
g AS (SELECT *, CASE WHEN len(all_parts) > 6 THEN list_append(all_parts[1:5], array_to_string(all_parts[6:], '/')) ELSE all_parts END seg FROM parts),
h AS (SELECT *, list_transform(seg, lambda e: regexp_replace(regexp_replace(e, '\p{L}+', 'a', 'g'), '[0-9]+', '0', 'g')) shp FROM g),
e AS (SELECT host, path, n, i, array_to_string(shp[1:i - 1], '/') above, seg[i] sg, shp[i] sh FROM h, range(1, 7) q(i) WHERE i <= len(seg)),
v AS (SELECT *, sum(n) OVER (PARTITION BY host, i, above, sg) nv, sum(n) OVER (PARTITION BY host, i, above) nn FROM e),
t AS (SELECT host, path, list(CASE WHEN nv >= 5 AND nv * 32 >= nn THEN sg ELSE '{' || sh || '}' END ORDER BY i) labels FROM v GROUP BY host, path),
l AS (SELECT p.*, coalesce(labels, []) labels, array_to_string(coalesce(labels, []), '/') template, CASE WHEN says = 'allow' THEN n ELSE 0 END a, CASE WHEN says = 'block' THEN n ELSE 0 END b FROM p LEFT JOIN t USING (host, path)),
m AS (SELECT host, template, labels, sum(n) n, sum(a) a, sum(b) b FROM l GROUP BY ALL),
c AS (SELECT host, template, i, array_to_string(labels[1:i - 1], '/') above, labels[i] branch, array_to_string(labels[i + 1:], '/') below, n, a, b FROM m, range(1, 7) q(i) WHERE i <= len(labels)),
w AS (SELECT *, sum(n) OVER (PARTITION BY host, i, above, below) same FROM c),
z AS (SELECT host, i, above, branch, CAST(sum(n) AS DOUBLE) n, sum(a) a, sum(b) b, sum(CAST(n * n AS DOUBLE) / same) sq FROM w GROUP BY ALL),
k AS (SELECT host, i, above, CAST(sum(n) AS DOUBLE) nn, sum(a) pa, sum(b) pb, CAST(count(DISTINCT below) - 1 AS DOUBLE) df FROM c GROUP BY ALL),
f AS (SELECT host, i, above, branch, z.n < nn AND (df = 0 OR (nn / z.n * sq - z.n) / nullif(1 - z.n / nn, 0) <= df * pow(1 - 2 / (9 * nullif(df, 0)) + 2.326347874 * sqrt(2 / (9 * nullif(df, 0))), 3))
  AND CASE WHEN a + b > 0 AND a + b < pa + pb AND pa > 0 AND pb > 0
    THEN pow(b - (a + b) * (pb / (pa + pb)), 2) / ((a + b) * (pb / (pa + pb)) * (1 - pb / (pa + pb)) * (1 - (a + b) / (pa + pb))) <= 6.634896601 ELSE true END alike
  FROM z JOIN k USING (host, i, above)),
o AS (SELECT host, template, array_to_string(list(CASE WHEN alike THEN '(*)' ELSE branch END ORDER BY i), '/') mg FROM c JOIN f USING (host, i, above, branch) GROUP BY ALL),
x AS (SELECT m.host, m.template, coalesce(mg, m.template) mg, a, b, regexp_extract(m.host, '([^.]*\.)?[^.]*$') site FROM m LEFT JOIN o USING (host, template)),
y AS (SELECT *, sum(a) OVER (PARTITION BY host, mg) ta, sum(b) OVER (PARTITION BY host, mg) tb, sum(a) OVER (PARTITION BY host) ha, sum(b) OVER (PARTITION BY host) hb,
  sum(a) OVER (PARTITION BY site) sa, sum(b) OVER (PARTITION BY site) sb, sum(a) OVER () ra, sum(b) OVER () rb FROM x),
j AS (SELECT host, template, mg, (tb + 4.0::DOUBLE * ((hb + 4.0::DOUBLE * ((sb + 4.0::DOUBLE * ((rb + 1.0::DOUBLE) / (ra + rb + 2.0::DOUBLE))) / (sa + sb + 4.0::DOUBLE))) / (ha + hb + 4.0::DOUBLE))) / (ta + tb + 4.0::DOUBLE) share FROM y)
SELECT page_id, host, path, rule, coalesce(says, CASE WHEN share >= 0.6::DOUBLE THEN 'block' ELSE 'allow' END) verdict, mg AS template
FROM s JOIN l USING (host, path) JOIN j USING (host, template)
"""
