"""URL filters by a path-template tree learnt per host from rule-labelled urls.

Per host, path segments are generalised level by level, down to the last segment that any path has: digit runs become `#`, a
level whose segments are mostly distinct becomes `*`, and sibling branches of statistically similar label rates are merged:
those that do not differ from all siblings together into `~`, and of the others those above the common rate that do not
differ from each other into `~+`, those below it into `~-`. A template is rejected when its smoothed labelled purity, backed
off from branch to host to corpus, is low.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, ascii_lower, durable

#: (verdict, host, path). A rule fits its host and all subdomains if the url's path starts with the rule's.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
#: A level with at least VARIABLE_ROWS urls, more than half of them in distinct segments, is variable.
VARIABLE_ROWS = 8
#: Chi-square with one degree of freedom at 5 %: a branch below it does not differ from what it is compared with.
DIFFERS = 3.84
#: Weight of the prior in a smoothed purity, in labelled urls.
PRIOR = 2.0
#: Levels that the SQL spells out, as it cannot take their number from the data.
SQL_LEVELS = 5


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): empty for a null url or one without `://`."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. The list is the operator's parameter, not data."""
    rule, verdict = F, F
    for what, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = rule.when(fits, F.lit(h + p)), verdict.when(fits, F.lit(what))
    return (rule, verdict) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def url_filter(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", min_purity: float = 0.5) -> DataFrame:
    """(id, host, path, rule, verdict, template), one row per row of pages.

    A rule decides the urls that it fits; these are the labelled urls from which the templates learn, and each other
    url gets its template's verdict: block if the smoothed share of allowed labels is below min_purity. Without any
    labels the share is a half. Null urls and those without `://` have empty host and path and are templates of the
    empty host. Repeated rows are judged each, null ids are carried, an empty table gives an empty one, and other
    columns take no part. Of rules that fit, the longest wins, and no two can be as long and fit the same url. Urls of any
    length are judged whole; a round of jobs is run for each segment of the longest path.
    """
    host, path = split_url(F.col(f"`{url_col}`"))
    x = pages.select(F.col(f"`{id_col}`").alias("id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    shape = F.transform(F.filter(F.split("path", "/"), lambda s: s != ""), lambda s: F.regexp_replace(s, "[0-9]+", "#"))
    x = x.withColumns({"rule": rule, "label": verdict, "seg": shape})
    # rows to shapes: what follows works on one row per host and shape
    shapes = x.groupBy("host", "seg").agg(F.count("*").alias("n"), F.count_if(F.col("label") == "block").alias("b"), F.count_if(F.col("label") == "allow").alias("a"))
    tree = durable(shapes)
    every = tree.agg(F.sum("a"), F.sum("b"), F.max(F.size("seg"))).first()
    allow, block, depth = (int(v or 0) for v in every)
    tree = _smoothed(tree.withColumns({"node": F.col("host"), "p": F.lit(allow / (allow + block) if allow + block else 0.5)}))
    ended = []
    for k in range(depth):
        ended.append(tree.where(F.size("seg") <= k))
        # written: each level is read several times, and a plan that holds all levels grows as a power of their number
        tree = durable(_smoothed(_named(tree.where(F.size("seg") > k).withColumn("s", F.get("seg", F.lit(k))))))
    for t in ended:
        tree = tree.unionByName(t)
    out = _smoothed(tree).select("host", "seg", F.col("node").alias("template"), F.col("p").alias("purity"))
    j = x.join(out, ["host", "seg"])
    final = F.coalesce("label", F.when(F.col("purity") < min_purity, "block").otherwise("allow"))
    return j.select("id", "host", "path", "rule", final.alias("verdict"), "template")


def _differs(b: Column, a: Column, of_b: Column, of_a: Column) -> Column:
    """Whether the block share of b and a differs from that of_b and of_a: chi-square, multiplied out to whole numbers, as
    (b/m - B/M)^2 m / (q (1 - q)) with q = B/M is m (bM - Bm)^2 > DIFFERS m^2 A B."""
    m = b + a
    gap = (b * (of_b + of_a) - of_b * m).cast("double")
    return (m > 0) & (gap * gap > F.lit(DIFFERS) * m.cast("double") * of_a.cast("double") * of_b.cast("double"))


def _named(tree: DataFrame) -> DataFrame:
    """tree with each row's node taken down to the name of its segment `s` among its siblings."""
    kin = tree.groupBy("host", "node", "s").agg(F.sum("n").alias("kn"), F.sum("b").alias("kb"), F.sum("a").alias("ka"))
    total = kin.groupBy("host", "node").agg(F.sum("kn").alias("n_"), F.count("*").alias("d_"), F.sum("kb").alias("b_"), F.sum("ka").alias("a_"))
    side = F.when(F.col("kb") * (F.col("b_") + F.col("a_")) > F.col("b_") * (F.col("kb") + F.col("ka")), "~+").otherwise("~-")
    j = kin.join(total, ["host", "node"]).withColumn("side", F.when(_differs(F.col("kb"), F.col("ka"), F.col("b_"), F.col("a_")), side).otherwise("~"))
    j = durable(j)
    like = j.groupBy("host", "node", "side").agg(F.count("*").alias("sd"), F.sum("kb").alias("sb"), F.sum("ka").alias("sa"))
    j = j.join(like, ["host", "node", "side"])
    variable = (F.col("n_") >= VARIABLE_ROWS) & (F.col("d_") * 2 > F.col("n_"))
    alone = (F.col("d_") == 1) | (F.col("side") != "~") & ((F.col("sd") == 1) | _differs(F.col("kb"), F.col("ka"), F.col("sb"), F.col("sa")))
    name = F.when(variable, "*").when(alone, F.col("s")).otherwise(F.col("side"))
    x = tree.join(j.select("host", "node", "s", name.alias("t")), ["host", "node", "s"])
    return x.withColumn("node", F.concat_ws("/", "node", "t")).drop("s", "t")


def _smoothed(tree: DataFrame) -> DataFrame:
    """tree with p, the share of allowed labels, taken on to each row's node: its own labels over the share before as prior."""
    node = tree.groupBy("host", "node").agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    p = (F.col("na") + F.lit(PRIOR) * F.col("p")) / (F.col("na") + F.col("nb") + F.lit(PRIOR))
    return tree.join(node, ["host", "node"]).withColumn("p", p).drop("na", "nb")


def url_report(pages: DataFrame) -> DataFrame:
    """The columns of the contract: page_id, host, path, rule, verdict, and the template. Odd rows and tables are as in
    url_filter."""
    return url_filter(pages).withColumnRenamed("id", "page_id")


def oracle() -> str:
    """DuckDB SQL for url_report over pages."""
    rules = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = lambda h, p: f"((host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}'))"
    rule = "case " + " ".join(f"when {fits(h, p)} then '{h}{p}'" for _, h, p in rules) + " end"
    label = "case " + " ".join(f"when {fits(h, p)} then '{w}'" for w, h, p in rules) + " end"
    raw = [f"s{k}" for k in range(SQL_LEVELS)]
    shapes = ", ".join(f"coalesce(regexp_replace(parts[{k + 1}], '[0-9]+', '#', 'g'), '') as s{k}" for k in range(SQL_LEVELS))
    differs = lambda b, a, B, A: f"({b} + {a} > 0 and power(({b} * ({B} + {A}) - {B} * ({b} + {a}))::double, 2) > {DIFFERS} * ({b} + {a})::double * {A}::double * {B}::double)"
    smooth = lambda p: f"(na + {PRIOR} * {p}) / (na + nb + {PRIOR})"
    sql = f"""with u as (select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
v as (select page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{UPPER.lower()}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
w as (select *, {rule} as rule, {label} as label, list_filter(string_split(path, '/'), lambda s: s <> '') as parts from v),
x as (select page_id, host, path, rule, label, {shapes} from w),
shapes as (select host, {', '.join(raw)}, count(*) as n, count(*) filter (where label = 'block') as b, count(*) filter (where label = 'allow') as a from x group by all),
root as (select *, host as node, (select case when sum(a) + sum(b) > 0 then sum(a)::double / (sum(a) + sum(b)) else 0.5 end from shapes) as p0 from shapes),
tree as (select root.* exclude (p0), {smooth('p0')} as p from root join (select host, node, sum(a) as na, sum(b) as nb from root group by all) using (host, node))"""
    last = "tree"
    for k in range(SQL_LEVELS):
        sql += f""",
go{k} as (select * from {last} where s{k} <> ''),
kin{k} as (select host, node, s{k}, sum(n) as kn, sum(b) as kb, sum(a) as ka from go{k} group by all),
total{k} as (select host, node, sum(kn) as n_, count(*) as d_, sum(kb) as b_, sum(ka) as a_ from kin{k} group by all),
side{k} as (select *, case when not {differs('kb', 'ka', 'b_', 'a_')} then '~' when kb * (b_ + a_) > b_ * (kb + ka) then '~+' else '~-' end as side from kin{k} join total{k} using (host, node)),
like{k} as (select host, node, side, count(*) as sd, sum(kb) as sb, sum(ka) as sa from side{k} group by all),
name{k} as (select host, node, s{k}, case when n_ >= {VARIABLE_ROWS} and d_ * 2 > n_ then '*'
  when d_ = 1 or side <> '~' and (sd = 1 or {differs('kb', 'ka', 'sb', 'sa')}) then s{k} else side end as t from side{k} join like{k} using (host, node, side)),
down{k} as (select go{k}.* exclude (node), concat_ws('/', node, t) as node from go{k} join name{k} using (host, node, s{k})),
level{k} as (select d.* exclude (p), {smooth('d.p')} as p from down{k} d join (select host, node, sum(a) as na, sum(b) as nb from down{k} group by all) using (host, node)),
tree{k} as (select * from level{k} union all by name select * from {last} where s{k} = '')"""
        last = f"tree{k}"
    sql += f""",
pure as (select t.host, t.{', t.'.join(raw)}, t.node as template, {smooth('t.p')} as purity from {last} t join (select host, node, sum(a) as na, sum(b) as nb from {last} group by all) using (host, node))"""
    return sql + f"""
select x.page_id, x.host, x.path, x.rule, coalesce(x.label, case when purity < 0.5 then 'block' else 'allow' end) as verdict, template
from x join pure using (host, {', '.join(raw)})"""
