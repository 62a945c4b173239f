"""URL rules: expand each URL into host-suffix and path-prefix expressions, meet rules by short hashes, then confirm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, same

HASH_DIGITS = 8


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a URL; both empty for a null or a text without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def _folder(path: Column) -> Column:
    """A path up to its last slash: what a rule is looked up by."""
    return F.regexp_extract(path, r"(?s)^(.*/)[^/]*$", 1)


def _digest(host: Column, folder: Column) -> Column:
    return F.sha2(F.concat_ws("\n", host, folder), 256)


def judge(pages: DataFrame, rules: DataFrame, id_column: str = "page_id", url_column: str = "url",
          default: str = "allow") -> DataFrame:
    """One row per page: ``id``, ``host``, ``path``, ``rule`` (host and path, or null), ``verdict``.

    ``rules``: ``host``, ``path``, ``verdict``.  A rule fits its host and all subdomains if the page's path starts
    with the rule's.  The longest rule (host and path) decides; then the longer host, then ``block``, then the
    least text.  Pages without a fitting rule get ``default``.

    A URL's expressions are its host suffixes times its path's folders, of the shapes (labels, slashes) that
    rules can have: up to the greatest number of labels and slashes of any rule, two numbers.  Expressions meet rules on
    ``HASH_DIGITS`` digits of a SHA-256, then the whole digest and the texts must agree.  A small
    rule table is broadcast by Spark's own size check; beyond it this is a shuffle join that splits skewed keys.

    Null URLs have an empty host and path; rules with a null host, path or verdict fit nothing; repeated rules and
    pages change nothing; rows of one id and URL are judged once and joined back, so null and
    repeated ids keep their rows.  Other columns are not read.
    """
    host, path = url_parts(F.col(url_column))
    pages = pages.select(F.col(id_column).alias("id"), host.alias("host"), path.alias("path"))
    rules = rules.dropna(subset=["host", "path", "verdict"]).select(
        F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict"))
    rules = rules.select("*", _folder(F.col("rule_path")).alias("rule_folder")).distinct()
    rules = rules.select("*", _digest(F.col("rule_host"), F.col("rule_folder")).alias("rule_digest"))
    rules = rules.withColumn("short", F.left("rule_digest", F.lit(HASH_DIGITS)))
    most = rules.agg(F.max(F.size(F.split("rule_host", r"\."))).alias("labels"),
                     F.max(F.size(F.split("rule_folder", "/"))).alias("slashes")).first()
    labels, slashes = most["labels"] or 0, (most["slashes"] or 1) - 1

    asked = pages.select("host", "path", F.col("id")).where("host <> ''").distinct()
    suffixes = F.expr(f"transform(sequence(1, least(size(split(host, '[.]')), {max(labels, 1)})), n -> substring_index(host, '.', -n))")
    # the empty folder serves rules whose path has no slash
    prefixes = F.expr(f"transform(sequence(0, least(size(split(path, '/')) - 1, {max(slashes, 0)})), "
                      "n -> if(n = 0, '', concat(substring_index(path, '/', n), '/')))")
    expressions = asked.select("id", "host", "path", F.explode(F.array_distinct(suffixes)).alias("suffix"), prefixes.alias("prefixes"))
    expressions = expressions.select("id", "host", "path", "suffix", F.explode("prefixes").alias("folder"))
    expressions = expressions.withColumn("digest", _digest(F.col("suffix"), F.col("folder")))
    expressions = expressions.withColumn("short", F.left("digest", F.lit(HASH_DIGITS)))
    fits = expressions.join(rules, "short").where(
        (F.col("digest") == F.col("rule_digest")) & (F.col("suffix") == F.col("rule_host"))
        & F.startswith("path", "rule_path"))
    order = F.struct((F.length("rule_host") + F.length("rule_path")).alias("length"), F.length("rule_host").alias("host_length"),
                     (F.col("rule_verdict") == "block").alias("blocks"), F.concat("rule_host", "rule_path").alias("rule"),
                     F.col("rule_verdict").alias("verdict"))
    best = fits.groupBy("id", "host", "path").agg(F.max(order).alias("best")).select(
        F.col("id").alias("best_id"), F.col("host").alias("best_host"), F.col("path").alias("best_path"), "best")
    keys = [(F.col(c), F.col(f"best_{c}")) for c in ("id", "host", "path")]
    return pages.join(best, same(keys), "left").select(
        "id", "host", "path", F.col("best")["rule"].alias("rule"), F.coalesce(F.col("best")["verdict"], F.lit(default)).alias("verdict"))
