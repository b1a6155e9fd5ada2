"""URL filters: pattern rules indexed by their rarest literal token.

A rule is (verdict, host, path): it fits its host and all subdomains if the URL's path starts with
the rule's. As a pattern it is one regular expression over ``host + '/' + path``. Its literal
tokens are its host labels and the whole path segments; the rarest one, by the number of rows of
the table that hold it, is its index key. A URL's tokens fetch candidate rules; only those run
their regular expression. Of the rules that fit the longest wins (then the longer host, then
block, then the rule's string).

Built-in functions only. The rules come from the caller's list, so the index is a literal
relation with the size of that list; distinct (host, path) pairs are judged once, and the verdicts
return to the rows by a join that adaptive execution can split.

Defined results: host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
lower-cased; path follows it up to ``?``, ``#`` or the end. Null URLs and URLs without ``://``
have an empty host and path, no rule and the default verdict. Repeated rows and null keys stay.
With no rules everything gets the default verdict. Extra columns are kept; a column of the input
named like an output column is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str) -> tuple[Column, Column]:
    """Host and path of a URL column."""
    c = F.col(url)
    at = F.locate("://", c)
    after = F.when(at > 0, c.substr(at + 3, F.length(c))).otherwise(F.lit(""))
    after = F.coalesce(after, F.lit(""))
    host = _lower(F.regexp_extract(after, r"(?s)^[^/?#]*", 0))
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def _tokens(host: Column, path: Column, whole: bool) -> Column:
    """Host labels and path segments. ``whole``: all of a URL's segments; else only the
    segments that a rule's path closes with a slash."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    parts = F.split(path, "/")
    if not whole:
        parts = F.when(F.size(parts) > 1, F.slice(parts, 1, F.size(parts) - 1)).otherwise(F.array().cast("array<string>"))
    parts = F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.concat(labels, parts))


def url_filter(rows: DataFrame, rules: Sequence[tuple[str, str, str]], *, url: str = "url", default: str = ALLOW) -> DataFrame:
    """The rows with ``host``, ``path``, ``rule`` (null where none fits) and ``verdict``."""
    spark = rows.sparkSession
    host, path = split_url(url)
    kept = [c for c in rows.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    hold = rows.withColumns({"_uf_host": host, "_uf_path": path}).select(
        *kept, F.col("_uf_host").alias("host"), F.col("_uf_path").alias("path")
    )
    patterns = [
        (v, h, p, h + p, rf"(?s)^(?:[^/]*\.)?{re.escape(h)}/\Q{p}\E" if "\\E" not in p else rf"(?s)^(?:[^/]*\.)?{re.escape(h)}/{re.escape(p)}")
        for v, h, p in dict.fromkeys((v, h.lower(), p) for v, h, p in rules)
    ]
    kind = "array<struct<_v:string,_h:string,_p:string,_rule:string,_regex:string>>"
    listed = F.array(*[F.struct(*[F.lit(x) for x in row]) for row in patterns]).cast(kind)
    table = spark.range(1).select(F.inline(listed))
    urls = rows.select(host.alias("host"), path.alias("path")).where(F.col("host") != "").distinct()
    url_tokens = urls.withColumn("_t", F.explode(_tokens(F.col("host"), F.col("path"), True)))
    rule_tokens = table.withColumn("_t", F.explode(_tokens(F.col("_h"), F.col("_p"), False)))
    held = (
        url_tokens.select("_t")
        .join(F.broadcast(rule_tokens.select("_t").distinct()), "_t")
        .groupBy("_t")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    rarest = Window.partitionBy("_rule", "_v").orderBy(F.coalesce("_n", F.lit(0)), "_t")
    index = (
        rule_tokens.join(held, "_t", "left")
        .withColumn("_k", F.row_number().over(rarest))
        .where(F.col("_k") == 1)
        .select("_t", "_v", "_h", "_rule", "_regex")
    )
    found = (
        url_tokens.join(F.broadcast(index), "_t")  # as many rows as the caller listed rules
        .where(F.expr("concat(host, '/', path) rlike _regex"))
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("_rule").alias("n"), F.length("_h").alias("h"), F.col("_v").alias("v"), F.col("_rule").alias("r"))).alias("_best"))
    )
    return (
        hold.join(found, ["host", "path"], "left")
        .select(
            *kept, "host", "path",
            F.col("_best.r").alias("rule"),
            F.coalesce(F.col("_best.v"), F.lit(default)).alias("verdict"),
        )
    )
