"""URL filtering by rules, and beyond them by a tree of path templates per host.

Every url becomes host, path and a template: the path's segments with their variable ones as wildcards. A segment is
variable if its form says so (numbers, hashes, dates), or if the tree says so: below one node of a host, too many
different segments for their urls. Templates of a host whose remaining segments have the same shape are similar
branches; they are merged unless their labelled urls differ by more than chance. A template is rejected if the
smoothed share of blocked urls among its labelled ones, drawn towards that of its merged branches, its host and all
hosts, reaches a limit. The labelled urls are those that a rule judges. Only DataFrame functions are used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.llm.shared import written


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def matched(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as struct(rule, verdict), else null. A rule fits its host and all subdomains."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def typed(segment: Column) -> Column:
    """A segment with its variable parts named: {date}, {id} for long hex, {n} for numbers."""
    s = F.regexp_replace(segment, r"\d{4}-\d{2}(-\d{2})?", "{date}")
    s = F.regexp_replace(s, r"(?i)\b[0-9a-f]*(?:[0-9][a-f]|[a-f][0-9])[0-9a-f]{6,}\b", "{id}")
    return F.regexp_replace(s, r"\d+", "{n}")


def _shrunk(bad: Column, all_: Column, towards: Column, weight: float) -> Column:
    return (bad + weight * towards) / (all_ + weight)


def templates(urls: DataFrame, *, depth: int, many: int, per_child: float) -> DataFrame:
    """(host, shape, template, labelled, blocked): a template for each different shape (typed segments) of a host."""
    t = urls.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count("label").alias("labelled"), F.coalesce(F.sum("label"), F.lit(0)).alias("blocked"))
    t = written(t.withColumn("template", F.lit("")), "shapes")
    for level in range(depth):
        segment = F.element_at("shape", level + 1)
        here = t.where(F.size("shape") > level)
        children = here.groupBy("host", "template", segment.alias("segment")).agg(F.sum("n").alias("n"))
        wild = children.groupBy("host", "template").agg(F.count("*").alias("kinds"), F.sum("n").alias("n")).where((F.col("kinds") >= many) & (F.col("n") < per_child * F.col("kinds"))).select("host", "template", F.lit(True).alias("wild"))
        t = t.join(wild, ["host", "template"], "left")
        part = F.when(F.col("wild"), F.lit("*")).otherwise(F.element_at("shape", level + 1))
        t = t.withColumn("template", F.when(F.size("shape") > level, F.concat("template", F.lit("/"), part)).otherwise(F.col("template"))).drop("wild")
    more = F.when(F.size("shape") > depth, F.concat("template", F.lit("/**"))).otherwise(F.col("template"))
    return t.withColumn("template", more)


def judged_urls(pages: DataFrame, rules: list[Rule], *, id_column: str = "page_id", url_column: str = "url", limit: float = 0.5, weight: float = 4.0, depth: int = 4, many: int = 20, per_child: float = 3.0, unlike: float = 2.58) -> DataFrame:
    """(id, host, path, rule, verdict) of every url: the longest rule's verdict, else the template's.

    Null urls and those without ``://`` have an empty host and path, and get the verdict of that template; rows that
    repeat are judged each. Without any labelled url the share of blocked ones is 0, and all are allowed.
    """
    host, path = split_url(F.col(url_column))
    given = pages.select(F.col(id_column).alias("id"), host.alias("host"), path.alias("path"))
    given = given.withColumn("found", matched(F.col("host"), F.col("path"), rules))
    shape = F.transform(F.filter(F.split("path", "/"), lambda s: s != ""), typed)
    given = given.withColumns({"shape": shape, "label": F.when(F.col("found").isNotNull(), (F.col("found.verdict") == "block").cast("int"))})
    t = templates(given, depth=depth, many=many, per_child=per_child)
    t = written(t, "templates")
    of = ["host", "template"]
    each = t.groupBy(*of).agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    # Similar branches: what follows the first segment has the same shape.
    each = each.withColumn("branch", F.regexp_replace("template", r"^/[^/]*", "/*"))
    pool = each.groupBy("host", "branch").agg(F.sum("labelled").alias("pool_n"), F.sum("blocked").alias("pool_bad"))
    each = each.join(pool, ["host", "branch"])
    p = F.col("pool_bad") / F.greatest("pool_n", F.lit(1))
    z = (F.col("blocked") - F.col("labelled") * p) / F.sqrt(F.greatest(F.col("labelled") * p * (1 - p), F.lit(0.25)))
    each = each.withColumn("alike", F.abs(z) <= unlike)
    merged = each.where("alike").groupBy("host", "branch").agg(F.sum("labelled").alias("like_n"), F.sum("blocked").alias("like_bad"))
    hosts = each.groupBy("host").agg(F.sum("labelled").alias("host_n"), F.sum("blocked").alias("host_bad"))
    whole = each.agg(F.coalesce(F.sum("blocked") / F.greatest(F.sum("labelled"), F.lit(1)), F.lit(0.0)).alias("all_share"))  # one row
    each = each.join(merged, ["host", "branch"], "left").join(hosts, "host").join(F.broadcast(whole))
    of_host = _shrunk(F.col("host_bad"), F.col("host_n"), F.col("all_share"), weight)
    of_like = F.when(F.col("alike"), _shrunk(F.coalesce("like_bad", F.lit(0)), F.coalesce("like_n", F.lit(0)), of_host, weight)).otherwise(of_host)
    each = each.withColumn("share", _shrunk(F.col("blocked"), F.col("labelled"), of_like, weight))
    each = written(each.select(*of, "share"), "shares")
    verdicts = t.select("host", F.concat_ws("/", "shape").alias("key"), "template").join(each, of).select("host", "key", "template", F.col("share"))
    out = given.withColumn("key", F.concat_ws("/", "shape")).join(verdicts.hint("shuffle_merge"), ["host", "key"], "left")
    own = F.when(F.col("share") >= limit, "block").otherwise("allow")
    return out.select("id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce(F.col("found.verdict"), own).alias("verdict"), "template", "share")
