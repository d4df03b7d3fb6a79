"""URL filters whose list entries come and go: a temporal list join.

A list is a table of dated changes (list, kind, pattern, action, changed_on).  The last change of
a day counts, and the changes of a pattern become the intervals in which its entry is active.
Every capture is held against the entries that were active on the day it was fetched: an as-of
join on the keys a URL can match by, which are its host, the host's parent domains, and the host
with each leading part of the path.

Kinds: ``host`` (the host alone), ``domain`` (a host and all below it), ``path`` (``host/a/b``
and all below it).  Hosts are compared without case.

All of it is DataFrame operations.  Captures are first reduced to distinct (key, day) pairs, so a
host of very many captures enters the join once a day, and results come back by (URL, day).

Defined cases: a null or unparsable URL matches nothing and has a null host; a null fetch day
matches nothing; changes with a null in any column are passed over; of changes on one day the
highest ``seq`` counts (``remove`` before ``add`` on a tie); removing what is not listed changes
nothing; rows that repeat are results of their own; empty tables give no matches or no rows.
Other columns are never looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_checked, stage

FAR = "9999-12-31"


def host_of(url: Column) -> Column:
    """Lower-case host of a URL with a scheme, without user, port and final dot; null if there is none."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    host = F.lower(F.regexp_replace(host, r"\.+$", ""))
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    """Path of a URL without query and fragment, without the leading and closing slash."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)", 1)
    return F.regexp_replace(path, "/+$", "")


def intervals(changes: DataFrame) -> DataFrame:
    """(list, kind, pattern, since, until): the days, ``until`` excluded, on which entries are active.

    A pattern has at most one row per day before its changes are put in order, however often it
    was changed.
    """
    order = F.struct("seq", (F.col("action") == "add").cast("int").alias("add"))
    daily = changes.where(F.expr("list IS NOT NULL AND kind IS NOT NULL AND pattern IS NOT NULL AND action IS NOT NULL "
                                 "AND changed_on IS NOT NULL AND seq IS NOT NULL")) \
        .groupBy("list", "kind", F.lower("pattern").alias("pattern"), "changed_on").agg(F.max(order).alias("last"))
    by = Window.partitionBy("list", "kind", "pattern").orderBy("changed_on")
    turns = daily.withColumn("on", F.col("last.add") == 1) \
        .withColumn("was", F.coalesce(F.lag("on").over(by), F.lit(False))).where("on != was")
    return turns.withColumn("until", F.coalesce(F.lead("changed_on").over(by), F.lit(FAR).cast("date"))) \
        .where("on").select("list", "kind", "pattern", F.col("changed_on").alias("since"), "until")


def url_keys(url: Column) -> Column:
    """array<struct<kind,pattern>> of everything an entry could name to match the URL."""
    host = host_of(url)
    labels, parts = F.split(host, r"\."), F.split(path_of(url), "/")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(
        F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("pattern")))
    paths = F.when(F.length(path_of(url)) > 0, F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(
            F.lit("path").alias("kind"),
            F.concat_ws("/", host, F.lower(F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("pattern"))))
    own = F.array(F.struct(F.lit("host").alias("kind"), host.alias("pattern")))
    none = F.array().cast("array<struct<kind:string,pattern:string>>")
    return F.when(host.isNull(), none).otherwise(F.concat(own, domains, F.coalesce(paths, none)))


def verdicts(captures: DataFrame, changes: DataFrame, url: str = "url", fetched_on: str = "fetched_on") -> DataFrame:
    """(url, fetched_on, lists, since) of the distinct captures that an active entry matches: the names
    of the lists, sorted, and the first day of the oldest of these entries."""
    seen = stage(captures.select(F.col(url).alias("url"), F.col(fetched_on).cast("date").alias("fetched_on"))
                 .where("url IS NOT NULL AND fetched_on IS NOT NULL").distinct())
    keyed = seen.select("url", "fetched_on", F.explode(url_keys(F.col("url"))).alias("k")) \
        .select("url", "fetched_on", "k.kind", "k.pattern")
    asked = keyed.select("kind", "pattern", "fetched_on").distinct()
    entries = stage(intervals(changes))
    active = join_checked(asked, entries, ["kind", "pattern"], "inner", row_bytes=160) \
        .where("since <= fetched_on AND fetched_on < until")
    answers = stage(active.groupBy("kind", "pattern", "fetched_on")
                    .agg(F.collect_set("list").alias("lists"), F.min("since").alias("since")))
    found = join_checked(keyed, answers, ["kind", "pattern", "fetched_on"], "inner", row_bytes=200)
    return found.groupBy("url", "fetched_on").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("lists")))).alias("lists"), F.min("since").alias("since"))


def filter_urls(captures: DataFrame, changes: DataFrame, url: str = "url", fetched_on: str = "fetched_on",
                keep: tuple[str, ...] = ()) -> DataFrame:
    """(*keep, url, host, fetched_on, lists, since, blocked) of every capture."""
    found = stage(verdicts(captures, changes, url, fetched_on))
    rows = captures.select(*keep, F.col(url).alias("url"), F.col(fetched_on).cast("date").alias("fetched_on"))
    return join_checked(rows, found, ["url", "fetched_on"], "left", row_bytes=300).select(
        *keep, "url", host_of(F.col("url")).alias("host"), "fetched_on",
        F.coalesce("lists", F.array().cast("array<string>")).alias("lists"), "since",
        F.col("lists").isNotNull().alias("blocked"))
