"""URL filters: explicit host and path rules, then association rules mined by FP-growth.

Every URL becomes a few tokens: top-level domain, last two host labels, first host label, the first
two path segments (digits as #) and the path's depth. Labelled pages (label row of the same id: bad
if of quality 0 or toxic) with their tokens and the outcome are the baskets; Spark's FP-growth finds
the frequent token sets, and rules towards ``block`` are kept from a support and a confidence on. The
fixed number of tokens of a URL bounds the sets it can have; the least support bounds the rules.

The rules go into an inverted index under their rarest token. URLs that no explicit rule fits are
looked up by their distinct token sets, so that a common host is looked up once, and a set that holds
all tokens of a rule is blocked; all else is allowed.

Edge cases: null URLs and URLs without :// have an empty host and path, no tokens, and are allowed;
without labelled pages there are no mined rules; repeated rows are judged alike; ties between explicit
rules can't be, as two of the same length that fit one URL are the same rule; extra columns are left out.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

#: Fixed rules of the contract: verdict, host, path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
SUPPORT, CONFIDENCE = 0.002, 0.5
#: Rules that are broadcast at most; more are joined by a shuffle.
BROADCAST_RULES = 50_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_parts(pages: DataFrame) -> DataFrame:
    """``pages`` with host and path."""
    rest = F.when(F.col("url").contains("://"), F.expr("substring(url, length(substring_index(url, '://', 1)) + 4)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return pages.withColumns({"host": host, "path": path})


def with_rule(pages: DataFrame, rules=RULES) -> DataFrame:
    """``pages`` (host, path) with rule (like ``net/``) and its verdict; the longest that fits, else null."""
    rule = verdict = F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, f"{host}{path}").otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return pages.withColumns({"rule": rule, "verdict": verdict})


def tokens():
    """Distinct tokens of host and path, sorted."""
    labels = F.split("host", r"\.")
    parts = F.filter(F.split(F.regexp_replace("path", r"\d+", "#"), "/"), lambda x: x != "")
    found = F.array(
        F.concat(F.lit("tld="), F.element_at(labels, -1)),
        F.when(F.size(labels) > 1, F.concat(F.lit("site="), F.substring_index("host", ".", -2))),
        F.when(F.size(labels) > 2, F.concat(F.lit("sub="), labels[0])),
        F.when(F.size(parts) > 0, F.concat(F.lit("p1="), F.get(parts, F.lit(0)))),
        F.when(F.size(parts) > 1, F.concat(F.lit("p2="), F.get(parts, F.lit(1)))),
        F.concat(F.lit("depth="), F.size(parts).cast("string")),
    )
    return F.when(F.col("host") != "", F.array_sort(F.array_distinct(F.array_compact(found)))).otherwise(F.array().cast("array<string>"))


def mine(pages: DataFrame, labels: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Rules towards block: antecedent, confidence, support, lift. ``pages`` has page_id, host, path."""
    bad = F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad")
    outcome = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("page_id")).agg(bad)
    baskets = (
        pages.join(outcome, "page_id")
        .select(tokens().alias("t"), F.when(F.col("bad") == 1, "y=block").otherwise("y=allow").alias("y"))
        .where(F.size("t") > 0)
        .select(F.array_append("t", F.col("y")).alias("items"))
    )
    baskets = settle(baskets)
    if baskets.isEmpty():
        return pages.sparkSession.createDataFrame([], "antecedent array<string>, confidence double, support double, lift double")
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    return model.associationRules.where(
        (F.size("consequent") == 1) & (F.col("consequent")[0] == "y=block")
    ).select("antecedent", "confidence", "support", "lift")


def blocked_sets(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """Of distinct token sets (key, t): the keys of those that hold all tokens of a rule."""
    rules = settle(rules.select("antecedent").distinct().withColumn("rule_id", F.monotonically_increasing_id()))
    lists = sets.select("key", "t", F.explode("t").alias("token"))
    counts = settle(lists.groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    entries = rules.select("rule_id", "antecedent", F.explode("antecedent").alias("token")).join(counts, "token")
    index = settle(
        entries.groupBy("rule_id").agg(F.min(F.struct("n", "token", "antecedent")).alias("m")).select("m.token", "m.antecedent")
    )
    small = index.count() <= BROADCAST_RULES
    hits = lists.join(F.broadcast(index) if small else index, "token")
    return hits.where(F.size(F.array_except("antecedent", "t")) == 0).select("key").distinct()


def judged(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """The contract's columns: page_id, host, path, rule, verdict."""
    own = with_rule(with_parts(pages.select("page_id", "url")), rules)
    own = settle(own.select("page_id", "host", "path", "rule", "verdict", tokens().alias("t")))
    mined = mine(own, labels)
    own = own.withColumn("key", F.when(F.isnull("verdict"), F.col("t")))  # the tokens themselves: joined, different ones could look alike
    sets = settle(own.where("size(key) > 0").select("key", F.col("key").alias("t")).distinct())
    blocked = settle(blocked_sets(sets, mined)).withColumn("blocked", F.lit(True))
    return own.join(blocked, "key", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("verdict", F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"),
    )


#: Mining by counting every token set of every basket, which the few tokens of a URL allow.
ORACLE = r"""
WITH rest AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
ruled AS (
  SELECT *, CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1'
                 WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/'
                 WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/'
                 WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/'
                 WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/' END AS rule,
         string_split(host, '.') AS l, list_filter(string_split(regexp_replace(path, '[0-9]+', '#', 'g'), '/'), lambda x: x <> '') AS s
  FROM parts),
tokened AS (
  SELECT page_id, host, path, rule, CASE WHEN host = '' THEN [] ELSE list_sort(list_distinct(list_filter([
    'tld=' || l[-1], CASE WHEN len(l) > 1 THEN 'site=' || l[-2] || '.' || l[-1] END, CASE WHEN len(l) > 2 THEN 'sub=' || l[1] END,
    CASE WHEN len(s) > 0 THEN 'p1=' || s[1] END, CASE WHEN len(s) > 1 THEN 'p2=' || s[2] END, 'depth=' || len(s)], lambda x: x IS NOT NULL))) END AS t
  FROM ruled),
outcome AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
baskets AS (SELECT t, bad FROM tokened JOIN outcome ON page_id = doc_id WHERE len(t) > 0),
sets AS (SELECT list_filter(t, lambda x, i: (m >> (i - 1)) & 1 = 1) AS c, bad FROM (SELECT t, bad, unnest(range(1, (1 << len(t))::BIGINT)) AS m FROM baskets)),
mined AS (
  SELECT c FROM sets GROUP BY c
  HAVING sum(bad) >= ceil(0.002 * (SELECT count(*) FROM baskets)) AND sum(bad) > 0 AND sum(bad) / count(*) >= 0.5),
hits AS (
  SELECT DISTINCT t FROM (
    SELECT t, list_filter(t, lambda x, i: (m >> (i - 1)) & 1 = 1) AS c
    FROM (SELECT t, unnest(range(1, (1 << len(t))::BIGINT)) AS m FROM (SELECT DISTINCT t FROM tokened WHERE rule IS NULL AND len(t) > 0))) JOIN mined USING (c))
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN hits.t IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM tokened LEFT JOIN hits ON tokened.t = hits.t
"""
