"""URL filters by association rules.

A short list of curated rules (host suffix and path prefix) judges the urls that it fits; those verdicts
are the labels. FP-growth mines the token combinations of labelled urls together with their label, and
combinations that imply a block with enough confidence and support become rules. They are held in an
inverted index (token to rules) and judge the urls that no curated rule fits: a url is blocked if all tokens
of a rule occur in it, else allowed.

A rule has one to ``MAX_TOKENS`` tokens, must name a host label, and tokens of more than half of the labelled urls are no
evidence: what is left speaks about sites, not about a language path or a top-level domain at large. All rules that qualify
count; a rule whose tokens contain those of another is redundant and goes.

Nothing comes to the driver. A rule stands in the index under its rarest token alone; the distinct token
sets of the urls are joined with it, and only a set that has the rarest token is held against the rest of the rule. Spark broadcasts the
index if it is small, and splits a hot token if not. Only DataFrame and SQL functions are used.

Defined results: a null url or one without ``://`` has an
empty host and path, no tokens, no rule and the verdict allow; very long urls are read whole; with no labelled urls nothing is mined and the rest is
allowed; of curated rules the longest wins, and of equally long ones the last in order; repeated rows are judged alike; an empty table gives an empty result;
other columns are carried under numbers of our own, so no name clashes, and one that has the name of a result is replaced by it.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import boxed, saved, table, unboxed

#: host, path, verdict
CURATED = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
MIN_SUPPORT = 0.01
MIN_CONFIDENCE = 0.8
MAX_TOKENS = 3
MAX_SHARE = 0.5
#: Parts that the urls of one token set are dealt to, as one site may hold a third of all.
SALTS = 32
BLOCK = "label=block"


def host_of(url: Column) -> Column:
    rest = F.substring_index(F.substr(url, F.instr(url, "://") + F.lit(3)), "/", 1)
    host = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    return F.when(F.instr(url, "://") > 0, F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substr(url, F.instr(url, "://") + F.lit(3))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def curated_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = CURATED) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null where none fits. ``(?s)`` is not needed: no pattern is used."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(host: Column, path: Column) -> Column:
    """Distinct tokens: the host's labels with the top-level domain marked, its first path segment and the path's depth."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    top = F.transform(F.slice(labels, -1, 1), lambda x: F.concat(F.lit("top="), x))
    names = F.transform(F.slice(labels, 1, F.greatest(F.size(labels) - 1, F.lit(0))), lambda x: F.concat(F.lit("host="), x))
    first = F.transform(F.slice(parts, 1, 1), lambda x: F.concat(F.lit("path="), x))
    depth = F.when(host == "", F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("depth="), F.size(parts).cast("string"))))
    return F.array_distinct(F.concat(F.when(F.size(labels) > 0, top).otherwise(F.array().cast("array<string>")), names, first, depth))


def _key(tokens: Column) -> Column:
    return F.concat_ws("\n", F.array_sort(tokens))


def mine(labelled: DataFrame, support: float = MIN_SUPPORT, confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(token, tokens): the rules that imply a block, each under its rarest token. ``labelled`` has tokens and verdict."""
    items = saved(labelled.select(F.concat("tokens", F.array(F.concat(F.lit("label="), F.col("verdict")))).alias("items")), "items")
    total = items.count()
    if not total:
        return labelled.select(F.lit("").alias("token"), "tokens").where("false")
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(items)
    sets = saved(model.freqItemsets.where(F.size("items") <= MAX_TOKENS + 1), "itemsets")
    is_label = lambda x: F.startswith(x, F.lit("label="))
    plain = sets.where(~F.exists("items", is_label)).select(_key(F.col("items")).alias("key"), F.col("freq").alias("n"))
    blocked = sets.where(F.array_contains("items", BLOCK) & (F.size("items") > 1))
    blocked = blocked.select(F.array_sort(F.filter("items", lambda x: ~is_label(x))).alias("tokens"), F.col("freq").alias("n_block")).withColumn("key", _key(F.col("tokens")))
    sure = blocked.join(plain, "key").where(F.col("n_block") / F.col("n") >= confidence).where(F.exists("tokens", lambda x: F.startswith(x, F.lit("host="))))
    # how often each token of a rule occurs: no rule may have one of over MAX_SHARE
    common = sets.where((F.size("items") == 1) & ~F.exists("items", is_label)).select(F.element_at("items", 1).alias("token"), F.col("freq").alias("often"))
    each = sure.select("key", "tokens", F.explode("tokens").alias("token")).join(common, "token")
    rules = each.groupBy("key", "tokens").agg(F.max("often").alias("most"), F.min(F.struct("often", "token")).alias("rarest"))
    rules = saved(rules.where(F.col("most") <= F.lit(MAX_SHARE) * total).select("key", "tokens", F.col("rarest.token").alias("token")), "rules")
    # smaller rules that a rule contains: leave one or two of its tokens out
    one = F.transform("tokens", lambda t: F.array_except(F.col("tokens"), F.array(t)))
    parts = F.concat(one, F.transform("tokens", lambda t: F.array(t)))
    inner = rules.where(F.size("tokens") > 1).select(F.col("key").alias("outer"), F.explode(parts).alias("part"))
    redundant = inner.withColumn("part", _key(F.col("part"))).join(rules.select(F.col("key").alias("part")), "part", "left_semi").select(F.col("outer").alias("key"))
    return rules.join(redundant, "key", "left_anti").select("token", "tokens")


def blocked_sets(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """Those of the distinct token sets (``tokens``) that hold all tokens of a rule."""
    entries = rules.select(F.col("token").alias("_token"), F.col("tokens").alias("rule"))
    found = sets.select("tokens", F.explode("tokens").alias("token")).join(entries, F.col("token") == F.col("_token"))
    return found.where(F.size(F.array_except("rule", "tokens")) == 0).select("tokens").distinct()


def judge(pages: DataFrame, support: float = MIN_SUPPORT, confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """``pages`` (url and others) with host, path, rule and verdict; columns of those names are replaced."""
    added = ("host", "path", "rule", "verdict")
    parsed = boxed(pages, text="url").withColumn("host", F.coalesce(host_of(F.col("url")), F.lit(""))).withColumn("path", F.coalesce(path_of(F.col("url")), F.lit("")))
    ruled = parsed.withColumn("fit", curated_rule(F.col("host"), F.col("path"))).withColumn("tokens", tokens(F.col("host"), F.col("path")))
    rules = mine(ruled.where("fit is not null").select("tokens", "fit.verdict"), support, confidence)
    open_ = ruled.where("fit is null")
    blocked = blocked_sets(open_.select("tokens").distinct(), rules)
    # urls with a curated rule stay out of the join
    salted = blocked.select(F.col("tokens").alias("bad"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    on = (F.col("tokens") == F.col("bad")) & (F.pmod(F.xxhash64("row", "url"), F.lit(SALTS)) == F.col("salt"))
    met = open_.join(salted, on, "left")
    met = met.withColumn("verdict", F.when(F.col("bad").isNotNull(), "block").otherwise("allow"))
    fitted = ruled.where("fit is not null").withColumn("verdict", F.col("fit.verdict"))
    columns = ["row", "url", "host", "path", F.col("fit.rule").alias("rule"), "verdict"]
    out = met.select(*columns).unionByName(fitted.select(*columns))
    return unboxed(out, pages, *added, without=added, text="url")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


_RULE_SQL = "CASE " + " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p} {v}'" for h, p, v in sorted(CURATED, key=lambda r: (len(r[0] + r[1]), r), reverse=True)
) + " END"
ORACLE_SQL = f"""
WITH u AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest,
  contains(coalesce(url, ''), '://') AS ok FROM pages),
hp AS (SELECT r, page_id, CASE WHEN ok THEN translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
  CASE WHEN ok THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM u),
f AS (SELECT *, {_RULE_SQL} AS fit, list_filter(string_split(host, '.'), lambda x: x <> '') AS labels, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM hp),
t AS (SELECT r, page_id, host, path, fit, list_distinct(list_concat(
  CASE WHEN len(labels) > 0 THEN ['top=' || labels[-1]] ELSE [] END, list_transform(labels[1 : len(labels) - 1], lambda x: 'host=' || x),
  list_transform(parts[1:1], lambda x: 'path=' || x), CASE WHEN host = '' THEN [] ELSE ['depth=' || len(parts)::VARCHAR] END)) AS toks FROM f),
one AS (SELECT r, fit, unnest(toks) AS t FROM t),
lab AS (SELECT r, t, fit LIKE '% block' AS bad FROM one WHERE fit IS NOT NULL
  AND t NOT IN (SELECT t FROM one WHERE fit IS NOT NULL GROUP BY t HAVING count(*) > {MAX_SHARE} * (SELECT count(*) FROM t WHERE fit IS NOT NULL))),
least_n AS (SELECT ceil({MIN_SUPPORT} * count(*)) AS k FROM t WHERE fit IS NOT NULL),
c1 AS (SELECT r, bad, [t] AS s FROM lab),
c2 AS (SELECT a.r, a.bad, [a.t, b.t] AS s FROM lab a JOIN lab b ON a.r = b.r AND a.t < b.t),
c3 AS (SELECT c2.r, c2.bad, list_append(s, c.t) AS s FROM c2 JOIN lab c ON c.r = c2.r AND s[2] < c.t),
n AS (SELECT s, count(*) AS n, count(*) FILTER (bad) AS n_bad FROM (SELECT * FROM c1 UNION ALL SELECT * FROM c2 UNION ALL SELECT * FROM c3) GROUP BY s),
rules AS (SELECT s FROM n, least_n WHERE len(list_filter(s, lambda x: starts_with(x, 'host='))) > 0 AND n_bad >= k AND n_bad > 0 AND n_bad / n >= {MIN_CONFIDENCE}::DOUBLE),
blocked AS (SELECT DISTINCT t.r FROM t JOIN rules ON len(list_intersect(t.toks, s)) = len(s))
SELECT page_id, host, path, split_part(fit, ' ', 1) AS rule,
  CASE WHEN fit IS NOT NULL THEN split_part(fit, ' ', 2) WHEN blocked.r IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM t LEFT JOIN blocked USING (r)
"""
