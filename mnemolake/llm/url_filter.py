r"""URL filters by a path-template tree (native).

Paths are cut at ``/`` into segments; numbers and hexadecimal ids get typed
wildcards at once. Per host a tree of prefixes is built level by level, each
level below the generalised steps of those above, so that what lies under
merged segments is counted together. Segments that all paths of a branch share
are passed in one step, so there are as many rounds as paths branch one below
the other, however deep they are. A word that is rare among many siblings is
variable and becomes ``*``; the other segments keep their word only where they
have no sibling or where their labelled share differs from that of the rest of
the branch by a two-proportion test, else they are merged into ``*`` too. Each
template's purity, its smoothed share of blocked labels, then decides: the prior
is the host's own smoothed share, the prior of that the share of blocked labels
among all urls, so that a host nobody labelled isn't rejected. A template at or
over the threshold is, if it has a label of its own: a host's labels may come from
rules for other branches and say nothing about it.

Labels are a table of pages known to be good or bad; without one, what the
explicit rules say is learnt from. A rule, where one fits, always has the last
word.

Defined cases: a null url, or one without ``://``, has an empty host and path and
is a template of its own; repeated urls count as often as they occur; a page with
several labels is blocked if any says so; equal rules are one rule; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import cut, or_empty, table

#: In a branch of at least this many words, those on at most this share of its urls are variable.
LEAST_WORDS = 8
MEAN_SHARE = 0.125
#: Two-sided 5 % point of the normal distribution.
DIFFERS = 1.96
#: Weight of the prior, in labels, and the share from which a template is rejected.
PRIOR_WEIGHT = 2.0
REJECT = 0.5

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def rule(verdict: str, text: str) -> UrlRule:
    host, slash, path = text.partition("/")
    return UrlRule(verdict, host, slash + path)


RULES = (rule("allow", "org/"), rule("block", "example.org/es/"), rule("block", "example.org/en/1"), rule("allow", "com/fr/"), rule("block", "com/de/"))


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3)))
    return or_empty(F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), UPPER, LOWER))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3)))
    return or_empty(F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1))


def _fitting(rules: tuple[UrlRule, ...], value) -> Column:
    """``value`` of the longest fitting rule, or null."""
    fits = [F.when(((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path), F.lit(value(r))) for r in sorted(set(rules), key=lambda r: (-len(r.text), -len(r.host), r.text, r.verdict))]
    return F.coalesce(*fits, F.lit(None).cast("string"))


def _segments(path: Column) -> Column:
    parts = F.split(F.regexp_replace(path, r"^/", ""), "/", -1)
    number = r"^[0-9]+(\.[A-Za-z0-9]{1,5})?$"
    hexed = r"^[0-9a-f-]*[0-9][0-9a-f-]*$"
    return F.transform(parts, lambda p: F.when(p.rlike(number), F.regexp_replace(p, r"^[0-9]+", "<n>")).when((F.length(p) >= 8) & p.rlike(hexed), "<h>").otherwise(p))


def _pass_shared(paths: DataFrame) -> DataFrame:
    """Moves every branch on past the segments that all its paths share."""
    rest = F.slice("typed", F.col("at") + 1, F.size("typed"))
    ends = paths.groupBy("host", "template").agg(F.min(rest).alias("a"), F.max(rest).alias("b"))
    least = F.least(F.size("a"), F.size("b"))
    unlike = F.filter(F.sequence(F.lit(0), least), lambda i: (i < least) & (F.get("a", i) != F.get("b", i)))
    ends = ends.select("host", "template", F.coalesce(F.array_min(unlike), least).alias("shared"))
    x = paths.join(ends, ["host", "template"])
    passed = F.slice("typed", F.col("at") + 1, F.col("shared"))
    more = F.when(F.col("shared") > 0, F.concat(F.lit("/"), F.array_join(passed, "/"))).otherwise("")
    return x.select("host", "typed", "n", "blocked", "labelled", (F.col("at") + F.col("shared")).alias("at"), F.concat("template", more).alias("template"))


def _step(paths: DataFrame) -> DataFrame:
    """``paths`` with their next segment, as it is or as ``*``, at the end of ``template``: the branch is the template so far."""
    steps = paths.withColumn("word", F.get("typed", F.col("at")))
    nodes = steps.where(F.col("word").isNotNull()).groupBy("host", "template", "word").agg(*[F.sum(c).alias(c) for c in ("n", "blocked", "labelled")])
    word = ~F.col("word").startswith("<") & (F.col("word") != "")
    branches = nodes.groupBy("host", "template").agg(F.sum(word.cast("long")).alias("words"), F.sum("n").alias("b_n"), F.sum("blocked").alias("b_blocked"), F.sum("labelled").alias("b_labelled"))
    nodes = nodes.join(branches, ["host", "template"])
    variable = (F.col("words") >= LEAST_WORDS) & (F.col("n") / F.col("b_n") <= MEAN_SHARE)
    rest_n, rest_b = F.col("b_labelled") - F.col("labelled"), F.col("b_blocked") - F.col("blocked")
    pool = F.try_divide("b_blocked", "b_labelled")
    error = F.sqrt(pool * (1 - pool) * (F.try_divide(F.lit(1.0), F.col("labelled")) + F.try_divide(F.lit(1.0), rest_n)))
    z = F.try_divide(F.abs(F.try_divide("blocked", "labelled") - F.try_divide(rest_b, rest_n)), error)
    tested = (F.col("labelled") > 0) & (rest_n > 0) & (pool > 0) & (pool < 1)
    differs = F.when(tested, z > DIFFERS).otherwise(F.lit(False))
    alone = F.col("words") <= 1
    kept = nodes.select("host", "template", "word", F.when(word & (variable | ~(differs | alone)), "*").otherwise(F.col("word")).alias("step"))
    out = steps.join(kept, ["host", "template", "word"], "left")
    on = F.col("step").isNotNull()
    return out.select("host", "typed", "n", "blocked", "labelled", (F.col("at") + on.cast("int")).alias("at"), F.when(on, F.concat("template", F.lit("/"), "step")).otherwise(F.col("template")).alias("template"))


def learn_templates(urls: DataFrame) -> DataFrame:
    """(host, typed, n, blocked, labelled), counted, -> the template, its purity and number of labels (``own``) of each (host, typed) path."""
    typed = urls.groupBy("host", "typed").agg(F.sum("n").alias("n"), F.sum("blocked").alias("blocked"), F.sum("labelled").alias("labelled"))
    paths = cut(_pass_shared(typed.withColumns({"at": F.lit(0), "template": F.lit("")})))
    while not paths.where(F.col("at") < F.size("typed")).isEmpty():
        paths = cut(_pass_shared(_step(paths)))
    templates = paths.groupBy("host", "template").agg(*[F.sum(c).alias(c) for c in ("n", "blocked", "labelled")])
    hosts = templates.groupBy("host").agg(F.sum("blocked").alias("h_blocked"), F.sum("labelled").alias("h_labelled"), F.sum("n").alias("h_n"))
    whole = hosts.agg(F.sum("h_blocked").alias("a_blocked"), F.sum("h_n").alias("a_n"))  # one row
    prior = F.coalesce(F.try_divide("a_blocked", "a_n"), F.lit(0.0))
    hosts = hosts.crossJoin(F.broadcast(whole)).select("host", ((F.col("h_blocked") + PRIOR_WEIGHT * prior) / (F.col("h_labelled") + PRIOR_WEIGHT)).alias("prior"))
    templates = templates.join(hosts, "host").select("host", "template", ((F.col("blocked") + PRIOR_WEIGHT * F.col("prior")) / (F.col("labelled") + PRIOR_WEIGHT)).alias("purity"), F.col("labelled").alias("own"))
    return paths.select("host", "typed", "template").join(templates, ["host", "template"])


def judge(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules: tuple[UrlRule, ...] = RULES, labels: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) of every url; ``labels`` has (page_id, blocked), blocked 0 or 1."""
    u = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    u = u.withColumn("rule", _fitting(rules, lambda r: r.text)).withColumn("said", _fitting(rules, lambda r: r.verdict)).withColumn("typed", _segments(F.col("path")))
    label = F.col("said")
    if labels is not None:
        known = labels.where(F.col("blocked").isNotNull()).groupBy(F.col(page_id).alias("_id")).agg(F.max("blocked").alias("_blocked"))
        u = u.join(known, F.col("page_id") == F.col("_id"), "left")
        label = F.when(F.col("_blocked") > 0, "block").when(F.col("_blocked").isNotNull(), "allow").otherwise(label)
    counted = u.withColumn("label", label).groupBy("host", "typed", "label").agg(F.count("*").alias("n"))
    counted = counted.select("host", "typed", "n", F.when(F.col("label") == "block", F.col("n")).otherwise(0).alias("blocked"), F.when(F.col("label").isNotNull(), F.col("n")).otherwise(0).alias("labelled"))
    out = u.join(learn_templates(counted), ["host", "typed"], "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("said", F.when((F.col("own") > 0) & (F.col("purity") >= REJECT), "block").otherwise("allow")).alias("verdict"), "template", F.round("purity", 9).alias("purity"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def _rule_sql(value) -> str:
    order = sorted(RULES, key=lambda r: (-len(r.text), -len(r.host), r.text, r.verdict))
    return "CASE " + " ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{value(r)}'" for r in order) + " END"


OP1_SQL = rf"""
WITH RECURSIVE r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u0 AS (SELECT page_id, translate(regexp_extract(rest, '\A([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '\A[^/?#]*([^?#]*)', 1) AS path FROM r),
u1 AS (SELECT *, {_rule_sql(lambda r: r.text)} AS rule, {_rule_sql(lambda r: r.verdict)} AS said, string_split(regexp_replace(path, '^/', ''), '/') AS p0 FROM u0),
u AS (SELECT page_id, host, path, rule, said, list_transform(p0, lambda p: CASE WHEN regexp_matches(p, '^[0-9]+(\.[A-Za-z0-9]{{1,5}})?$') THEN regexp_replace(p, '^[0-9]+', '<n>')
       WHEN length(p) >= 8 AND regexp_matches(p, '^[0-9a-f-]*[0-9][0-9a-f-]*$') THEN '<h>' ELSE p END) AS typed FROM u1),
t AS (SELECT host, typed, count(*) AS n, count(*) FILTER (said = 'block') AS blocked, count(said) AS labelled FROM u GROUP BY host, typed),
lv AS (SELECT host, typed, n, blocked, labelled, 0 AS k, '' AS template FROM t
  UNION ALL SELECT host, typed, n, blocked, labelled, k + 1, template || '/' || CASE WHEN is_word AND ((words >= {LEAST_WORDS} AND wn / bn::DOUBLE <= {MEAN_SHARE}) OR NOT (words <= 1 OR
       CASE WHEN wl > 0 AND bl > wl AND bb > 0 AND bb < bl THEN abs(wb / wl::DOUBLE - (bb - wb) / (bl - wl)::DOUBLE) / sqrt((bb / bl::DOUBLE) * (1 - bb / bl::DOUBLE) * (1.0::DOUBLE / wl + 1.0::DOUBLE / (bl - wl))) > {DIFFERS} ELSE false END)) THEN '*' ELSE word END
  FROM (SELECT *, sum(n) OVER w AS wn, sum(blocked) OVER w AS wb, sum(labelled) OVER w AS wl, sum(n) OVER b AS bn, sum(blocked) OVER b AS bb, sum(labelled) OVER b AS bl,
         count(DISTINCT CASE WHEN is_word THEN word END) OVER b AS words
        FROM (SELECT *, typed[k + 1] AS word, NOT (starts_with(typed[k + 1], '<') OR typed[k + 1] = '') AS is_word FROM lv WHERE k < len(typed)) WINDOW w AS (PARTITION BY host, template, word), b AS (PARTITION BY host, template))),
p AS (SELECT * FROM lv WHERE k = len(typed)),
tp AS (SELECT host, template, sum(n) AS n, sum(blocked) AS blocked, sum(labelled) AS labelled FROM p GROUP BY ALL),
h AS (SELECT host, (sum(blocked) + {PRIOR_WEIGHT} * coalesce((SELECT sum(blocked) / nullif(sum(n), 0) FROM tp), 0)) / (sum(labelled) + {PRIOR_WEIGHT}) AS prior FROM tp GROUP BY host),
pu AS (SELECT host, template, labelled AS own, (blocked + {PRIOR_WEIGHT} * prior) / (labelled + {PRIOR_WEIGHT}) AS purity FROM tp JOIN h USING (host))
SELECT page_id, u.host, path, rule, coalesce(said, CASE WHEN own > 0 AND purity >= {REJECT} THEN 'block' ELSE 'allow' END) AS verdict, p.template, round(purity, 9) AS purity
FROM u JOIN p USING (host, typed) JOIN pu ON pu.host = u.host AND pu.template = p.template
"""
