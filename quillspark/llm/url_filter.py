"""URL filters as a sort-merge range join over canonical keys.

A canonical key is the host's labels in reverse, joined by dots, a null character and the path. A rule (host, path) is a
prefix of such keys, hence the interval from it to the least text above all that it begins. Since a rule also fits the subdomains of its host, each url is
looked up under every suffix of its host that is no deeper than the deepest rule. Rules' starts and ends and the urls'
keys are merged in key order; along the order a stack holds the nested rules that are open, and its top is the longest
rule that fits the key. The sweep runs in buckets: urls are salted over them, and the rule events, whose number is the
rule set's, go to each. The longest rule over a url's suffixes decides.

Defined results: null urls and urls without `://` have an empty host and path and no rule; the last of repeated equal
rules holds; without a fitting rule the verdict is `default`. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import ascii_lower, table

# Fixed values of the contract: host, path, verdict.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
EVENT = [("key", "string"), ("phase", "int"), ("top", "string"), ("top_verdict", "string")]
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
END = "\0"  # of the host in a key


def canonical(host: str, path: str) -> str:
    return ".".join(reversed(host.split("."))) + END + path


def above(prefix: str) -> str:
    """The least text above all that begin with the prefix, in order of code points."""
    prefix = prefix.rstrip(chr(0x10FFFF))
    code = ord(prefix[-1]) + 1
    return prefix[:-1] + chr(0xE000 if code == 0xD800 else code)  # surrogates are no characters


def rule_events(rules: list[tuple[str, str, str]]) -> list[tuple[str, int, str | None, str | None]]:
    """(key, phase, rule, verdict): at each start or end of a rule, the rule then on top of the stack.

    Phase 0 is an end, 1 a start; urls have phase 2, so that a url equal to a rule's start lies inside.
    """
    keyed = {canonical(h, p): (h + p, v) for h, p, v in rules}
    marks = sorted([(k, 1, k) for k in keyed] + [(above(k), 0, k) for k in keyed])
    stack: list[str] = []
    out = []
    for key, phase, rule in marks:
        stack.append(rule) if phase else stack.remove(rule)
        out.append((key, phase, *(keyed[stack[-1]] if stack else (None, None))))
    return out


def apply_rules(urls: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", default: str = "allow", buckets: int | None = None) -> DataFrame:
    spark = urls.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    url = F.coalesce(F.col(url_col), F.lit(""))
    base = urls.select(
        F.col(id_col).alias("page_id"),
        ascii_lower(F.regexp_extract(url, URL, 1)).alias("host"),
        F.regexp_extract(url, URL, 2).alias("path"),
    )
    if not rules:
        return base.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    depth = max(len(h.split(".")) for h, _, _ in rules)
    labels = F.reverse(F.split("host", r"\."))
    # every row gets its keys; the window below brings a row's keys to its bucket, and max over them is a narrow step
    row = F.struct("page_id", "host", "path")
    keys = (
        base.withColumn("labels", labels)
        .withColumn("cut", F.explode(F.expr(f"sequence(1, least({depth}, size(labels)))")))
        .select(
            F.pmod(F.xxhash64("page_id", "host", "path"), F.lit(buckets)).cast("int").alias("bucket"),
            F.concat(F.array_join(F.slice("labels", F.lit(1), F.col("cut")), "."), F.lit(END), "path").alias("key"),
            F.lit(2).alias("phase"), F.lit(None).cast("string").alias("top"), F.lit(None).cast("string").alias("top_verdict"), F.col("cut"), row.alias("row"),
        )
    )
    marks = F.array(*[F.struct(*[F.lit(x).cast(t).alias(n) for x, (n, t) in zip(e, EVENT)]) for e in rule_events(rules)])
    events = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.explode(marks).alias("e")).select(
        "bucket", "e.*",
        F.lit(0).alias("cut"), F.lit(None).cast(keys.schema["row"].dataType).alias("row"),
    )
    sweep = Window.partitionBy("bucket").orderBy("key", "phase").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    state = F.last(F.when(F.col("phase") < 2, F.struct("top", "top_verdict")), ignorenulls=True).over(sweep)
    swept = keys.unionByName(events).withColumn("open", state).where("phase = 2")
    best = F.max(F.when(F.col("open.top").isNotNull(), F.struct(F.length("open.top"), "cut", F.col("open.top").alias("rule"), F.col("open.top_verdict").alias("verdict"))))
    # one row of the table has one key of each depth: counting those of depth 1 restores repeated rows
    found = swept.groupBy("bucket", "row").agg(best.alias("best"), F.count(F.when(F.col("cut") == 1, 1)).alias("n"))
    found = found.withColumn("again", F.explode(F.expr("sequence(1L, n)")))
    return found.select("row.page_id", "row.host", "row.path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "pages"), RULES)


ORACLE = r"""
WITH rules(rhost, rpath, rverdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
p AS (SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
m AS (SELECT page_id, rhost || rpath AS rule, rverdict,
    row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC) AS k
  FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT p.page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict
FROM p LEFT JOIN m ON m.page_id = p.page_id AND k = 1
"""
