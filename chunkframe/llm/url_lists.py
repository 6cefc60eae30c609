"""URL filter by dated lists, as an as-of join in DataFrame operations only.

A list is a log of dated entries (``domain, listed_on, action``: ``add`` or
``remove``).  Entries of a domain become validity intervals ``[start, stop)``, and every
capture is judged against the interval that is active when it was fetched: the last
entry of each of the capture's host suffixes at or before the fetch time.

The join is on the host suffix.  Captures are first reduced to distinct pairs of host
and fetch time; the verdict goes back to the captures on that pair.

Defined results: a null, empty or malformed address has no host and is kept; IPv4 and IPv6
addresses (``10.0.0.1``, ``[::1]``) match as whole hosts only; a null fetch time is judged as before all entries; several entries of one domain and time:
``remove`` wins over ``add``; repeated captures are judged each; an empty list keeps
everything; empty tables give empty tables; input columns with the names of the
outputs are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._common import scratch_name, without, written

#: scheme, credentials, host; ports, paths, queries and a final dot of the host are left out
_HOST = r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]/?#@]*\]|[^/?#:@]+?)[.]?(?::[0-9]*)?(?:[/?#].*)?$"
#: IPv4 and (in brackets) IPv6 hosts: numbers have no parent domains
_ADDRESS = r"^(?:\[.*\]|[0-9]+(?:[.][0-9]+){3})$"


def host_of(url: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(F.trim(url)), _HOST, 1), F.lit(""))


def suffixes(host: Column) -> Column:
    """The host and its parent domains, down to two labels (one, if it has no more); of an
    address the host alone."""
    labels = F.split(host, "[.]")
    last = F.greatest(F.size(labels) - 1, F.lit(1))
    domains = F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.when(host.rlike(_ADDRESS), F.array(host)).otherwise(domains)


def intervals(entries: DataFrame) -> DataFrame:
    """``domain, listed_on, action`` -> ``domain, start, stop`` of the spans in which the
    domain is listed; ``stop`` null: still listed.  Adjacent ``add`` entries merge."""
    one = entries.where("domain is not null and listed_on is not null and action in ('add', 'remove')")
    one = one.groupBy(F.lower("domain").alias("domain"), F.col("listed_on").cast("timestamp_ntz").alias("at")).agg(F.max("action").alias("action"))
    order = W.partitionBy("domain").orderBy("at")
    change = one.withColumn("before", F.lag("action").over(order)).where("before is null or before != action")
    ended = change.withColumn("stop", F.lead("at").over(order))
    return ended.where("action = 'add'").select("domain", F.col("at").alias("start"), "stop")


def judge(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """``captures`` with ``host``, ``listed_domain`` (the longest listed suffix at fetch
    time, or null) and ``kept``."""
    h, t = scratch_name(captures, "h"), scratch_name(captures, "at")
    at = F.col(time_col).cast("timestamp_ntz")
    hosted = without(captures, "host", "listed_domain", "kept", keep=(url_col, time_col)).withColumn("host", host_of(F.col(url_col)))
    distinct = hosted.where(F.col("host").isNotNull()).select(F.col("host").alias("h"), at.alias("at")).distinct()
    spans = written(intervals(entries), "intervals")
    asked = distinct.withColumn("suffix", F.explode(suffixes(F.col("h"))))
    met = asked.join(spans, (F.col("suffix") == F.col("domain")) & (F.col("start") <= F.col("at")) & (F.col("stop").isNull() | (F.col("at") < F.col("stop"))))
    named = met.groupBy("h", "at").agg(F.max_by("suffix", F.length("suffix")).alias("listed_domain"))
    named = written(named.withColumnsRenamed({"h": h, "at": t}), "listed")
    return hosted.join(named, (F.col("host") == F.col(h)) & (at == F.col(t)), "left").drop(h, t).withColumn("kept", F.col("listed_domain").isNull())
