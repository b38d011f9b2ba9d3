"""URL filters by a temporal list join.

List entries are dated: an entry adds a domain to a list or takes it off again. Ordered by date, each entry of a
(list, domain) becomes the validity interval until the next one. A capture meets the entries of its host and of every
parent domain by an equality join, and the as-of condition since <= fetched_at < until picks the one that was in force at
fetch time; it blocks if it is an "add". So every capture is judged by the lists of its own day.

Entries of one (list, domain) and date: the last by action, "remove" after "add", holds. Defined cases: a null or hostless
url and a null fetch time match nothing and are kept as not blocked; entries with a null domain or date are ignored;
domains compare in lower case without a leading "www."; every domain of two labels or more counts as a parent, public
suffixes such as co.uk included; urls of any length are read whole; repeated captures are judged each; an empty table
gives an empty result. Extra columns of captures are kept; output columns replace those of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def host_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.nullif(host, F.lit(""))


def parents_of(host: Column) -> Column:
    """The host and its parent domains of two labels or more."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.when(host.isNull(), F.array().cast("array<string>")).when(n < 2, F.array(host)).otherwise(
        F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))
    )


def intervals(entries: DataFrame) -> DataFrame:
    """entries (list, domain, dated, action) -> (list, domain, since, until) of the times when a domain was listed."""
    one = (
        entries.where(F.col("domain").isNotNull() & F.col("dated").isNotNull())
        .select("list", F.regexp_replace(F.lower("domain"), r"^www\.", "").alias("domain"), "dated", "action")
        .groupBy("list", "domain", "dated")
        .agg(F.max("action").alias("action"))
    )
    until = F.lead("dated").over(Window.partitionBy("list", "domain").orderBy("dated"))
    return one.withColumn("until", until).where("action = 'add'").select("list", "domain", F.col("dated").alias("since"), "until")


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures (url, fetched_at, ...) with host, n_lists (lists in force that hold the host or a parent), lists and blocked."""
    valid = intervals(entries).select(F.col("list").alias("_uf_list"), F.col("domain").alias("_uf_domain"), F.col("since").alias("_uf_since"), F.col("until").alias("_uf_until"))
    # A (host, time) is looked up once, however many captures have it: hot hosts shrink before the join.
    asked = captures.select(host_of(F.col("url")).alias("_uf_host"), F.col("fetched_at").alias("_uf_at")).where("_uf_host is not null and _uf_at is not null").distinct()
    asked = asked.withColumn("_uf_domain", F.explode(parents_of(F.col("_uf_host"))))
    in_force = (F.col("_uf_since") <= F.col("_uf_at")) & (F.col("_uf_until").isNull() | (F.col("_uf_at") < F.col("_uf_until")))
    hits = asked.join(valid, "_uf_domain").where(in_force).groupBy("_uf_host", "_uf_at").agg(F.array_sort(F.collect_set("_uf_list")).alias("_uf_lists"))
    # The input row goes along as one column, so that none of its names can clash with those used here.
    judged = captures.select(F.struct("*").alias("row")).withColumn("_uf_own", host_of(F.col("row.url")))
    judged = judged.join(hits, (F.col("_uf_own") == F.col("_uf_host")) & (F.col("row.fetched_at") == F.col("_uf_at")), "left")
    lists = F.coalesce("_uf_lists", F.array().cast("array<string>"))
    added = {"host": F.col("_uf_own"), "lists": F.array_join(lists, ","), "n_lists": F.size(lists).cast("long"), "blocked": F.size(lists) > 0}
    done = judged.select("row", F.struct(*[v.alias(k) for k, v in added.items()]).alias("added"))
    return done.select(*[F.col("row")[c].alias(c) for c in captures.columns if c.lower() not in added], "added.*")
