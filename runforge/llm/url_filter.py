"""URL filters by a sort-merge range join over reversed-host canonical keys.

A rule (host, path) covers the keys that begin with its own key, an interval of the sorted
key space, and such intervals nest or are disjoint. Rules and URLs are range-partitioned
by key and swept in order; the rule that started last carries the stack of rules it is
nested in, and the active ones are those of the stack that still cover the URL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runforge.llm.common import ascii_lower, cut, load, shuffle_partitions

#: Between reversed host and path; what it might confuse is settled by comparing host and path themselves.
MARK = "\x01"
#: The rules of the query: host, path, verdict (fixed values).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
DEFAULT_VERDICT = "allow"


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty if there is none."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty if there is no ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _reversed(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.", -1)), ".")


def _rule_stacks(rules: DataFrame) -> DataFrame:
    """A row for each rule: rule_host, key, and its stack, itself and the rules around it, widest first.

    Of equal rules with several verdicts block wins. A stack is at most as high as the
    rule's path is long.
    """
    clean = (
        rules.where("host is not null and path is not null and host <> ''")
        .groupBy(ascii_lower("host").alias("rule_host"), F.col("path").alias("rule_path"))
        .agg(F.max("verdict").alias("verdict"))
    )
    around = clean.select(
        "rule_host", F.col("rule_path").alias("inner_path"),
        F.explode(F.sequence(F.lit(0), F.length("rule_path"))).alias("n"),
    ).select("rule_host", "inner_path", F.expr("substring(inner_path, 1, n)").alias("rule_path"))
    return (
        around.join(clean, ["rule_host", "rule_path"])
        .groupBy("rule_host", "inner_path")
        .agg(F.sort_array(F.collect_list(F.struct(F.length("rule_path").alias("n"), "rule_path", "verdict", "rule_host"))).alias("stack"))
        .select("rule_host", F.concat(_reversed(F.col("rule_host")), F.lit(MARK), "inner_path").alias("key"), "stack")
    )


def filter_urls(urls: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT, url_col: str = "url") -> DataFrame:
    """Adds host, path, rule and verdict to every row of urls.

    rules has host, path, verdict. A rule fits its host and all subdomains if the URL's path
    starts with the rule's; the longest (host and path together, then host) wins. rule is
    host and path of the winner or null, verdict its verdict or the default. Null URLs and
    those without :// have an empty host and path, which no rule fits. Repeated URLs are
    swept once. Columns of urls named host, path, rule or verdict are replaced.
    """
    spark = urls.sparkSession
    out = urls.drop("host", "path", "rule", "verdict").withColumns({"host": url_host(F.col(url_col)), "path": url_path(F.col(url_col))})
    stacks = _rule_stacks(rules)
    labels = F.split("host", r"\.", -1)
    keys = (
        out.select("host", "path").where("host <> ''").distinct()
        .select("host", "path", F.explode(F.sequence(F.lit(1), F.size(labels))).alias("n"))
        .select("host", "path", F.array_join(F.slice(labels, -F.col("n"), F.col("n")), ".").alias("rule_host"))
        .join(stacks.select("rule_host").distinct(), "rule_host", "left_semi")
        .select("host", "path", "rule_host", F.concat(_reversed(F.col("rule_host")), F.lit(MARK), "path").alias("key"))
    )
    events = keys.withColumns({"kind": F.lit(1), "stack": F.lit(None).cast(stacks.schema["stack"].dataType)}).unionByName(
        stacks.select("rule_host", "key", "stack", F.lit(0).alias("kind")), allowMissingColumns=True
    )
    # The sweep within each range. It is cut here, as both the carried stacks and the
    # matches need the same ranges.
    in_order = Window.partitionBy("range_no").orderBy("key", "kind")
    swept = cut(
        events.repartitionByRange(shuffle_partitions(spark), "key", "kind")
        .withColumn("range_no", F.spark_partition_id())
        .withColumn("started", F.last("stack", ignorenulls=True).over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    )
    # What was started last before a range begins: one row for each range.
    ends = swept.where("kind = 0").groupBy("range_no").agg(F.max_by("started", "key").alias("started"))
    carried = (
        swept.select("range_no").distinct().join(ends, "range_no", "left")
        .select("range_no", F.last("started", ignorenulls=True).over(Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    )
    covers = lambda s: (s["rule_host"] == F.col("rule_host")) & F.col("path").startswith(s["rule_path"])
    winners = (
        swept.where("kind = 1").join(F.broadcast(carried), "range_no")
        .withColumn("top", F.try_element_at(F.filter(F.coalesce("started", "carried"), covers), F.lit(-1)))
        .where("top is not null")
        .select("host", "path", F.concat("rule_host", "top.rule_path").alias("rule"), "top.verdict", F.length("rule_host").alias("n_host"))
        .groupBy("host", "path")
        .agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), "n_host")).alias("won"))
    )
    w = winners.select(F.col("host").alias("w_host"), F.col("path").alias("w_path"), "won")
    return (
        out.join(w, (F.col("host") == F.col("w_host")) & (F.col("path") == F.col("w_path")), "left")
        .withColumns({"rule": F.col("won.rule"), "verdict": F.coalesce("won.verdict", F.lit(default))})
        .drop("won", "w_host", "w_path")
    )


def rule_table(spark, rules=RULES) -> DataFrame:
    rows = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    return spark.sql(f"select * from values {rows} as rules(host, path, verdict)")


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


ORACLE = """
with rules(rhost, rpath, rverdict) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
p as (select page_id,
  coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
  coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path from pages),
m as (select p.*, rhost || rpath as rule, rverdict,
  row_number() over (partition by page_id order by length(rhost || rpath) desc nulls last, length(rhost) desc) as k
  from p left join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath))
select page_id, host, path, rule, coalesce(rverdict, 'allow') as verdict from m where k = 1
"""
