"""URL filters by a path-template tree (operator 3, native).

Per host, path segments are generalised lexically (numbers, hashes). Then the tree is built from the top, below places that
are generalised already: where a place has many children that each hold a small share of its pages, these become wildcards,
apart by whether their labelled rate is that of the place, above or below it; of the others, branches with alike
continuations and alike rates are merged. A template's purity is its labelled share of bad pages, smoothed towards the place
above it, and so on up to its host, domain and all; it is rejected by the purity of the deepest place on its way that has
enough labelled pages. Labels are the verdicts of the rules, or a column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import aside, cut, small, table, temporary

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules of the query: host, path, verdict.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: A child is rare if it holds less than one part in SHARE of its place's pages; MIN_RARE of them make the place variable.
SHARE, MIN_RARE = 16, 16
#: Pseudo-pages of the share above, labelled pages that a judgement needs, and the purity that is rejected.
STRENGTH, MIN_LABELLED, REJECT = 4.0, 5, 0.7
#: Rates and continuations are alike if so many standard errors apart at most; continuations also at a chi-squared of so
#: much a page, whatever the number of pages.
NEAR, SLIGHT = 2.0, 0.1


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for null and for what has no ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.translate(raw, UPPER, LOWER), F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest) + 1), "^[^?#]*", 0)


def match_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def generalise(segment: Column) -> Column:
    """Numbers as {n}, hashes as {h}; braces of the url itself as %7B and %7D."""
    whole = F.when(segment.rlike("^[0-9]+\\z"), "{n}").when(segment.rlike("^[0-9A-Fa-f-]{8,}\\z") & segment.rlike("[0-9]"), "{h}")
    plain = F.regexp_replace(F.translate(segment, "{}", "\x01\x02"), "[0-9]+", "{n}")
    return F.coalesce(whole, F.replace(F.replace(plain, F.lit("\x01"), F.lit("%7B")), F.lit("\x02"), F.lit("%7D")))


def form_of(segment: Column) -> Column:
    """What a continuation looks like: words as w, numbers as 0, hashes as #."""
    return F.regexp_replace(F.replace(F.replace(segment, F.lit("{n}"), F.lit("0")), F.lit("{h}"), F.lit("#")), "[A-Za-z]+([-_][A-Za-z]+)*", "w")


def _sums(*more: Column) -> list[Column]:
    return [*(F.sum(c).alias(c) for c in ("n", "paths", "labelled", "bad")), *more]


def name_children(front: DataFrame) -> DataFrame:
    """From rows (host, at, rest, n, labelled, bad), one for each path that goes on below place at: host, at, seg, name and
    place_paths, where seg is a child and name what it is called in the tree."""
    place, child = ["host", "at"], ["host", "at", "seg"]
    formed = front.groupBy(*place, F.get("rest", F.lit(0)).alias("seg"), form_of(F.coalesce(F.get("rest", F.lit(1)), F.lit(""))).alias("form")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("paths"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    formed = cut(formed, "url-forms")
    children = formed.groupBy(*child).agg(*_sums(F.max_by("form", F.struct("n", "form")).alias("main")))
    places = children.groupBy(*place).agg(F.sum("n").alias("place_n"), F.sum("paths").alias("place_paths"), F.sum("labelled").alias("place_labelled"), F.sum("bad").alias("place_bad"))
    children = children.join(places, place).withColumn("rare", F.col("n") * SHARE < F.col("place_n"))
    variable = children.where("rare").groupBy(*place).agg(F.count(F.lit(1)).alias("rares"))
    children = children.join(variable, place, "left").withColumn("wild", F.col("rare") & (F.coalesce("rares", F.lit(0)) >= MIN_RARE))
    rate = F.try_divide("place_bad", "place_labelled")
    gap, error = F.try_divide("bad", "labelled") - rate, NEAR * F.sqrt(F.try_divide(rate * (1 - rate), F.col("labelled"))) + 1e-9
    told = F.col("labelled") >= MIN_LABELLED
    children = cut(children.withColumn("side", F.when(told & (gap > error), "+").when(told & (gap < -error), "-").otherwise("")), "url-children")

    group = ["host", "at", "side", "main"]
    plain = children.where(~F.col("wild"))
    own = formed.select(*child, "form", F.col("n").alias("form_n")).join(plain.select(*child, "side", "main", "n"), child)
    pool = own.groupBy(*group, "form").agg(F.sum("form_n").alias("pool_n"))
    pools = pool.groupBy(*group).agg(F.sum("pool_n").alias("pool"), (F.count(F.lit(1)) - 1).alias("free"))
    far = own.join(pool, [*group, "form"]).join(pools, group).groupBy(*child, "side", "main", "n", "free").agg((F.sum(F.col("form_n") * F.col("form_n") * (F.col("pool") / F.col("pool_n"))) / F.col("n") - F.col("n")).alias("far"))
    alike = far.where((F.col("far") <= F.col("free") + NEAR * F.sqrt(2.0 * F.col("free")) + 1e-9) | (F.col("far") <= SLIGHT * F.col("n")))
    merged = alike.groupBy(*group).agg(F.count(F.lit(1)).alias("many")).where("many > 1").select(*group)
    merged = alike.join(merged, group).select(*child, F.lit(True).alias("merged"))
    name = F.when(F.col("wild"), F.concat(F.lit("{*"), "side", F.lit("}"))).when(F.col("merged"), F.concat(F.lit("{m"), "side", F.lit("|"), "main", F.lit("}"))).otherwise(F.col("seg"))
    return children.join(merged, child, "left").select(*child, name.alias("name"), "place_paths")


def tree(known: DataFrame) -> DataFrame:
    """From rows (host, lex, bad), bad null where unlabelled: one row per host and lex with template, purity, labelled, reject.

    One round for each level at which some place still has two paths."""
    counted = known.groupBy("host", "lex").agg(F.count(F.lit(1)).alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("bad"))
    rows = ["host", "lex", "at", "rest", "n", "labelled", "bad"]
    level = cut(counted.select("host", "lex", F.lit("").alias("at"), F.filter(F.split("lex", "/"), lambda s: s != "").alias("rest"), "n", "labelled", "bad"), "url-paths")
    done = [level.where("size(rest) = 0")]
    front = level.where("size(rest) > 0")
    while front.head(1):
        names = cut(name_children(front), "url-names")
        names = small(names, names.count())
        moved = front.withColumn("seg", F.get("rest", F.lit(0))).join(names, ["host", "at", "seg"])
        last = F.col("place_paths") == 1
        at = F.concat_ws("/", F.when(F.col("at") != "", F.col("at")), F.when(last, F.array_join("rest", "/")).otherwise(F.col("name")))
        none = F.array().cast("array<string>")
        level = cut(moved.select("host", "lex", at.alias("at"), F.when(last, none).otherwise(F.slice("rest", F.lit(2), F.size("rest"))).alias("rest"), "n", "labelled", "bad").select(*rows), "url-level")
        done.append(level.where("size(rest) = 0"))
        front = level.where("size(rest) > 0")
    paths = reduce(DataFrame.unionByName, done).select("host", "lex", F.col("at").alias("template"), "labelled", "bad")

    templates = cut(paths.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")), "url-templates")
    depth = F.when(F.col("template") == "", 0).otherwise(F.size(F.split("template", "/")))
    steps = templates.select("*", F.explode(F.sequence(F.lit(0), depth)).alias("pos")).withColumn("above", F.array_join(F.slice(F.split("template", "/"), F.lit(1), F.col("pos")), "/"))
    nodes = steps.groupBy("host", "above").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
    ways = steps.join(nodes, ["host", "above"]).groupBy("host", "template").agg(F.array_sort(F.collect_list(F.struct("pos", "l", "b"))).alias("way"))  # as long as the path is deep
    domain = F.regexp_extract("host", r"[^.]*\.[^.]*$|^[^.]*$", 0)
    domains = templates.groupBy(domain.alias("domain")).agg(F.sum("labelled").alias("dl"), F.sum("bad").alias("db"))
    whole = domains.agg(F.coalesce(F.sum("dl"), F.lit(0)).alias("n"), F.coalesce(F.sum("db"), F.lit(0)).alias("bad")).first()
    share = (whole["bad"] + 1) / (whole["n"] + 2)
    zero = F.struct(((F.col("db") + STRENGTH * share) / (F.col("dl") + STRENGTH)).alias("p"), F.lit(None).cast("double").alias("judged"))

    def smooth(s: Column, x: Column) -> Column:
        p = (x["b"] + STRENGTH * s["p"]) / (x["l"] + STRENGTH)
        return F.struct(p.alias("p"), F.when(x["l"] >= MIN_LABELLED, p).otherwise(s["judged"]).alias("judged"))

    scored = ways.withColumn("domain", domain).join(domains, "domain").select("host", "template", F.aggregate("way", zero, smooth).alias("s"))
    scored = scored.select("host", "template", F.col("s.p").alias("purity"), (F.coalesce("s.judged", F.lit(0.0)) >= REJECT).alias("reject"))
    return paths.select("host", "lex", "template").join(templates.select("host", "template", "labelled").join(scored, ["host", "template"]), ["host", "template"])


def filter_urls(df: DataFrame, url: str = "url", rules=RULES, label: str | None = None) -> DataFrame:
    """Add host, path, rule, verdict, template, purity and labelled to every row.

    label: a boolean column, true for bad pages, null where unknown; without it the rules' verdicts are the labels. Null or
    malformed urls: empty host and path, no rule, allowed unless their template is rejected. Repeated rows all count. Empty
    table: empty result. Columns of these names that the input has are replaced; other names can't clash.
    """
    new = {"host", "path", "rule", "verdict", "template", "purity", "labelled"}
    own, name = aside(df)
    host, path = parts(F.col(name[url]))
    read = own.select("*", host.alias("host"), path.alias("path"))
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    lex = F.array_join(F.transform(F.filter(F.split("path", "/"), lambda s: s != ""), generalise), "/")
    read = read.select("*", rule.alias("rule"), verdict.alias("ruled"), lex.alias("lex"))
    bad = F.col(name[label]).cast("boolean") if label else F.when(F.col("ruled").isNotNull(), F.col("ruled") == "block")
    with temporary() as keep:
        known = keep(cut(tree(read.select("host", "lex", bad.alias("bad"))), "url-tree"))
    out = read.join(small(known, known.count()), ["host", "lex"], "left")
    kept = [F.col(name[c]).alias(c) for c in df.columns if c not in new]
    return out.select(*kept, "host", "path", "rule", F.coalesce("ruled", F.when(F.col("reject"), "block").otherwise("allow")).alias("verdict"), "template", "purity", "labelled")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return out.select("page_id", "host", "path", "rule", "verdict", "template", F.round("purity", 6).alias("purity"), "labelled")


QUERIES = {"op3_url_templates": op3}
#: Levels of the tree that the SQL writes out; paths of pages have two.
LEVELS = 3


def _level_sql(i: int) -> str:
    """SQL that moves paths from level i (f{i}) to the next."""
    form = "regexp_replace(replace(replace(coalesce(rest[2], ''), '{n}', '0'), '{h}', '#'), '[A-Za-z]+([-_][A-Za-z]+)*', 'w', 'g')"
    rate = "(place_bad / place_labelled)"
    error = f"{NEAR} * sqrt({rate} * (1 - {rate}) / labelled) + 1e-9"
    return f"""
s{i} AS MATERIALIZED (SELECT host, spot, rest[1] AS seg, {form} AS form, sum(n)::BIGINT AS n, count(*) AS paths, sum(labelled)::BIGINT AS labelled, sum(bad)::BIGINT AS bad FROM f{i} WHERE len(rest) > 0 GROUP BY ALL),
c{i} AS (SELECT host, spot, seg, sum(n)::BIGINT AS n, sum(paths)::BIGINT AS paths, sum(labelled)::BIGINT AS labelled, sum(bad)::BIGINT AS bad, first(form ORDER BY n DESC, form DESC) AS main FROM s{i} GROUP BY ALL),
p{i} AS (SELECT host, spot, sum(n)::BIGINT AS place_n, sum(paths)::BIGINT AS place_paths, sum(labelled)::BIGINT AS place_labelled, sum(bad)::BIGINT AS place_bad FROM c{i} GROUP BY ALL),
k{i} AS MATERIALIZED (SELECT *, n * {SHARE} < place_n AND count(*) FILTER (n * {SHARE} < place_n) OVER (PARTITION BY host, spot) >= {MIN_RARE} AS wild,
  CASE WHEN labelled >= {MIN_LABELLED} AND bad / labelled - {rate} > {error} THEN '+' WHEN labelled >= {MIN_LABELLED} AND bad / labelled - {rate} < -({error}) THEN '-' ELSE '' END AS side FROM c{i} JOIN p{i} USING (host, spot)),
o{i} AS (SELECT k.host, k.spot, k.seg, form, s.n AS form_n, side, main, k.n FROM s{i} s JOIN k{i} k USING (host, spot, seg) WHERE NOT wild),
q{i} AS (SELECT host, spot, side, main, form, sum(form_n)::BIGINT AS pool_n FROM o{i} GROUP BY ALL),
t{i} AS (SELECT host, spot, side, main, sum(pool_n)::BIGINT AS pool, count(*) - 1 AS free FROM q{i} GROUP BY ALL),
a{i} AS (SELECT host, spot, seg, side, main FROM o{i} JOIN q{i} USING (host, spot, side, main, form) JOIN t{i} USING (host, spot, side, main) GROUP BY host, spot, seg, side, main, n, free
  HAVING sum(form_n * form_n * (pool / pool_n)) / n - n <= greatest(free + {NEAR} * sqrt(2.0 * free) + 1e-9, {SLIGHT} * n)),
m{i} AS (SELECT host, spot, seg FROM a{i} QUALIFY count(*) OVER (PARTITION BY host, spot, side, main) > 1),
n{i} AS MATERIALIZED (SELECT host, spot, seg, place_paths, CASE WHEN wild THEN '{{*' || side || '}}' WHEN m.seg IS NOT NULL THEN '{{m' || side || '|' || main || '}}' ELSE seg END AS name FROM k{i} LEFT JOIN m{i} m USING (host, spot, seg)),
f{i + 1} AS MATERIALIZED (SELECT f.host, lex, concat_ws('/', nullif(f.spot, ''), CASE WHEN place_paths = 1 THEN array_to_string(rest, '/') ELSE name END) AS spot, CASE WHEN place_paths = 1 THEN [] ELSE rest[2:] END AS rest, n, labelled, bad
  FROM f{i} f JOIN n{i} x ON x.host = f.host AND x.spot = f.spot AND x.seg = f.rest[1] WHERE len(rest) > 0 UNION ALL SELECT * FROM f{i} WHERE len(rest) = 0),"""


def _oracle() -> str:
    name, verdict = "NULL", "NULL"
    for h, p, v in sorted(RULES, key=lambda r: len(r[0] + r[1])):
        fits = f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
        name, verdict = f"CASE WHEN {fits} THEN '{h}{p}' ELSE {name} END", f"CASE WHEN {fits} THEN '{v}' ELSE {verdict} END"
    plain = "regexp_replace(translate(s, '{}', chr(1) || chr(2)), '[0-9]+', '{n}', 'g')"
    lex = rf"CASE WHEN regexp_matches(s, '^[0-9]+\z') THEN '{{n}}' WHEN regexp_matches(s, '^[0-9A-Fa-f-]{{8,}}\z') AND regexp_matches(s, '[0-9]') THEN '{{h}}' ELSE replace(replace({plain}, chr(1), '%7B'), chr(2), '%7D') END"
    return f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
v AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
h AS (SELECT page_id, translate(raw, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM v),
z AS MATERIALIZED (SELECT *, {name} AS rule, {verdict} AS ruled, array_to_string(list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: {lex}), '/') AS lex FROM h),
f0 AS MATERIALIZED (SELECT host, lex, '' AS spot, list_filter(string_split(lex, '/'), lambda s: s <> '') AS rest, count(*) AS n, count(ruled) AS labelled, count(*) FILTER (ruled = 'block') AS bad FROM z GROUP BY host, lex),
{"".join(_level_sql(i) for i in range(LEVELS))}
y AS MATERIALIZED (SELECT host, lex, concat_ws('/', nullif(spot, ''), CASE WHEN len(rest) > 0 THEN array_to_string(rest, '/') END) AS template, labelled, bad FROM f{LEVELS}),
tm AS MATERIALIZED (SELECT host, template, regexp_extract(host, '[^.]*\\.[^.]*$|^[^.]*$') AS domain, sum(labelled)::BIGINT AS labelled, sum(bad)::BIGINT AS bad FROM y GROUP BY ALL),
st AS (SELECT host, template, pos, array_to_string(string_split(template, '/')[1:pos], '/') AS above, labelled, bad FROM (SELECT *, unnest(range(0, CASE WHEN template = '' THEN 1 ELSE len(string_split(template, '/')) + 1 END)) AS pos FROM tm)),
nd AS (SELECT host, above, sum(labelled)::BIGINT AS l, sum(bad)::BIGINT AS b FROM st GROUP BY ALL),
al AS (SELECT (coalesce(sum(bad), 0) + 1) / (coalesce(sum(labelled), 0) + 2) AS share FROM tm),
dm AS (SELECT domain, (sum(bad) + {STRENGTH} * any_value(share)) / (sum(labelled) + {STRENGTH}) AS p FROM tm, al GROUP BY domain),
wy AS (SELECT host, template, list({{'l': l, 'b': b, 'p': 0.0::DOUBLE, 'judged': 0.0::DOUBLE}} ORDER BY pos) AS way FROM st JOIN nd USING (host, above) GROUP BY ALL),
sc AS (SELECT host, template, labelled, list_reduce(list_prepend({{'l': 0::BIGINT, 'b': 0::BIGINT, 'p': p::DOUBLE, 'judged': 0.0::DOUBLE}}, way), lambda s, x:
  {{'l': x.l, 'b': x.b, 'p': (x.b + {STRENGTH} * s.p) / (x.l + {STRENGTH}), 'judged': CASE WHEN x.l >= {MIN_LABELLED} THEN (x.b + {STRENGTH} * s.p) / (x.l + {STRENGTH}) ELSE s.judged END}}) AS r FROM wy JOIN tm USING (host, template) JOIN dm USING (domain))
SELECT page_id, z.host, path, rule, coalesce(ruled, CASE WHEN r.judged >= {REJECT} THEN 'block' ELSE 'allow' END) AS verdict, y.template, round(r.p, 6) AS purity, sc.labelled
FROM z JOIN y ON y.host = z.host AND y.lex = z.lex JOIN sc ON sc.host = y.host AND sc.template = y.template"""


ORACLES = {"op3_url_templates": _oracle()}
