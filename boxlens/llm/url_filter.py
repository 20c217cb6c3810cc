"""Operator 8: URL filters by pattern rules indexed by their rarest literal token.

A rule is a pattern over ``host + path`` (host in lower case): ``||`` in front anchors it at a
label of the host, ``*`` stands for any run, ``^`` for a separator or either end, everything else
for itself.  Rules become regular expressions and literal tokens by SQL functions; each rule is
filed under the token of it that the URLs contain least often.  URL tokens fetch the rules filed
under them by an equi-join, and only those run their regular expression.  A rule without a
bounded token is filed under the empty token, which every URL has.

The join runs over distinct (host, path); the rule index is small, and Spark broadcasts it if its
stored size allows and joins by shuffle otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boxlens.session import pin

#: host rules: (rule, verdict); a rule is host/path and fits the host and its subdomains
HOST_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: patterns that block where no host rule fits
PATTERNS = ("||ads-track.", "||free-bets.", "||cheap-pills.", "||spam-farm.", "^adserver^", "^doubleclick^", "/popunder^", "^casino-*/bonus^")

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased;
    path from there up to ``?``, ``#`` or the end; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_table(spark: SparkSession, host_rules=HOST_RULES, patterns=PATTERNS) -> DataFrame:
    """(name, pattern, verdict): name is null for patterns that are not host rules."""
    rows = [F.struct(F.lit(n).alias("name"), F.lit("||" + n).alias("pattern"), F.lit(v).alias("verdict")) for n, v in host_rules]
    rows += [F.struct(F.lit(None).cast("string").alias("name"), F.lit(p).alias("pattern"), F.lit("block").alias("verdict")) for p in patterns]
    return spark.range(1).select(F.inline(F.array(*rows)))


def compiled(rules: DataFrame) -> DataFrame:
    """Adds regex and tokens (literal runs bounded on both sides inside the pattern)."""
    p = F.regexp_replace("pattern", r"^\|\|", "")
    body = F.regexp_replace(p, r"([\\.\[\]{}()+?$|])", r"\\$1")
    body = F.replace(body, F.lit("^"), F.lit("(?:[^A-Za-z0-9%]|^|$)"))
    body = F.replace(body, F.lit("*"), F.lit(".*"))
    regex = F.when(F.startswith("pattern", F.lit("||")), F.concat(F.lit(r"(?s)^(?:[^/]*\.)?"), body)).otherwise(F.concat(F.lit("(?s)"), body))
    low = F.translate("pattern", UPPER, LOWER)
    tokens = F.array_distinct(F.regexp_extract_all(low, F.lit(r"(?<=[^a-z0-9%*])([a-z0-9%]+)(?=[^a-z0-9%*])"), F.lit(1)))
    return rules.select("*", regex.alias("regex"), tokens.alias("tokens"))


def url_tokens(text: Column) -> Column:
    return F.array_distinct(F.split(F.translate(text, UPPER, LOWER), "[^a-z0-9%]+"))


def judge(pages: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """One row per row of ``pages`` (page_id, url): page_id, host, path, rule, verdict.

    Of the host rules that fit, the longest name wins (of equal names, 'block'); rule is its name
    and verdict its verdict.  Without one, rule is null and verdict is 'block' if any pattern
    matches, else 'allow'.  A null url, or one without ``://``, has empty host and path, which no
    host rule fits.  Repeated rows are judged alike; other columns are ignored."""
    spark = pages.sparkSession
    host, path = split_url(F.col("url").cast("string"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    subjects = pin(parsed.select("host", "path").distinct())
    words = subjects.select("host", "path", F.explode(F.array_union(url_tokens(F.concat("host", "path")), F.array(F.lit("")))).alias("token"))
    comp = pin(compiled(rule_table(spark) if rules is None else rules).withColumn("rid", F.monotonically_increasing_id()))
    # how often the URLs contain each token of a rule, counted over all of them
    of_rules = comp.select("rid", F.explode("tokens").alias("token"))
    freq = words.join(of_rules.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("freq"))
    rare = Window.partitionBy("rid").orderBy("freq", "token")
    filed = (of_rules.join(freq, "token", "left").withColumn("freq", F.coalesce("freq", F.lit(0)))
                     .withColumn("_r", F.row_number().over(rare)).filter("_r = 1").select("rid", "token"))
    index = pin(comp.join(filed, "rid", "left").select(F.coalesce("token", F.lit("")).alias("token"), "name", "regex", "verdict"))
    fetched = words.join(index, "token").filter(F.regexp_like(F.concat("host", "path"), F.col("regex")))
    named = F.when(F.col("name").isNotNull(), F.struct(F.length("name").alias("n"), "name", F.col("verdict").alias("v")))
    found = pin(fetched.groupBy("host", "path").agg(F.max(named).alias("best"), F.max((F.col("name").isNull() & (F.col("verdict") == "block")).cast("int")).alias("hit")))
    # matched subjects grow with the pages: their stored size says little of their size in memory
    out = parsed.join(found.hint("merge"), ["host", "path"], "left")
    return out.select("page_id", "host", "path", F.col("best.name").alias("rule"),
                      F.coalesce("best.v", F.when(F.col("hit") == 1, "block").otherwise("allow")).alias("verdict"))
