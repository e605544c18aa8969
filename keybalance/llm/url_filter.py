"""Temporal URL filter: every capture against the list entries active when it was fetched.

Dated list entries (add or remove a host or domain from a list) become validity
intervals per list and key. A capture is looked up by its host and by each parent
domain, as of its fetch time: entry starts and captures of one key are ordered by
time, and a running last value carries the entry that is in force to the captures
behind it. This reads each row once, whatever the number of entries of a key.

A key with many captures is split: its captures are dealt over slots by their own
identity, and its entries, which are few against the captures, go to every slot. The
number of slots follows from the key's share of the captures, so a host with a third
of them is spread like the rest.

Defined results: a capture without URL, host or fetch time matches no entry and is
kept. Of two entries for a key at one instant, ``remove`` wins. An entry is in force
from its instant on, up to but not at the next entry's. Repeated captures get equal
rows; entries without list, key or instant are ignored; extra columns of captures
are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from keybalance.functions.keys import column_ref
from keybalance.llm.native import free_name, once

#: Captures of one key that one slot takes, as a share of all captures.
SLOT_SHARE = 400
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"


def host_of(url: Column) -> Column:
    """Lower-case host without a trailing dot; null if the URL has none."""
    host = F.rtrim(F.lower(F.regexp_extract(url, HOST, 1)), F.lit("."))
    return F.when(host != "", host)


def keys_of(host: Column) -> Column:
    """The host and its parent domains down to two labels."""
    labels = F.split(host, r"\.")
    return F.when(
        host.isNotNull(),
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
            lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
        ),
    )


def intervals(entries: DataFrame) -> DataFrame:
    """list, key, since, until (null: still in force) of the spans in which a key is listed.

    ``entries`` has list, key, at, action ('add' or 'remove').
    """
    usable = entries.where(
        F.col("list").isNotNull() & F.col("key").isNotNull() & F.col("at").isNotNull()
    )
    state = usable.groupBy("list", "key", "at").agg(F.bool_and(F.col("action") == "add").alias("on"))
    ahead = Window.partitionBy("list", "key").orderBy("at")
    return (
        state.withColumn("until", F.lead("at").over(ahead))
        .where("on")
        .select("list", "key", F.col("at").alias("since"), "until")
    )


def _slots(captures: DataFrame) -> DataFrame:
    """key, slots for the keys that hold more than one slot's share of the captures.

    Fewer than SLOT_SHARE keys for each label of a host can qualify, which bounds the
    table and its broadcast.
    """
    total = captures.count()
    counts = captures.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    share = F.ceil(F.col("n") * SLOT_SHARE / F.lit(max(total, 1))).cast("int")
    return counts.select("key", share.alias("slots")).where("slots > 1")


def active_entries(
    captures: DataFrame, entries: DataFrame, lists: list[str] | None = None
) -> DataFrame:
    """Distinct (host, fetched) with the listed keys in force: blocked_by array<string>.

    ``captures`` has url and fetched. Only distinct pairs are looked up, so
    captures of one host at one time cost one row.
    """
    seen = (
        captures.select(host_of(F.col("url")).alias("host"), F.col("fetched"))
        .where(F.col("host").isNotNull() & F.col("fetched").isNotNull())
        .distinct()
    )
    asked = seen.select("host", "fetched", F.explode(keys_of(F.col("host"))).alias("key"))
    slots = F.broadcast(_slots(asked.select("key")))
    of_key = F.coalesce("slots", F.lit(1))
    left = asked.join(slots, "key", "left").select(
        "key",
        F.pmod(F.xxhash64("host", "fetched"), of_key).cast("int").alias("slot"),
        F.col("fetched").alias("at"),
        "host",
        F.lit(None).cast("array<string>").alias("by"),
    )
    valid = intervals(entries)
    if lists is not None:
        valid = valid.where(F.col("list").isin(lists))
    none = F.array().cast("array<string>")
    # what is listed for a key from each instant of a change on, until the next
    bounds = F.array(F.struct(F.col("since").alias("at")), F.struct(F.col("until").alias("at")))
    changes = valid.select("key", F.inline(bounds)).where(F.col("at").isNotNull()).distinct()
    held = (F.col("since") <= F.col("at")) & (F.col("until").isNull() | (F.col("at") < F.col("until")))
    listed = (
        changes.join(valid.withColumnRenamed("key", "__key"), (F.col("key") == F.col("__key")) & held, "left")
        .groupBy("key", "at")
        .agg(F.collect_set(F.concat_ws(":", "list", "__key")).alias("found"), F.count("list").alias("n"))
        .select("key", "at", F.when(F.col("n") > 0, F.col("found")).otherwise(none).alias("by"))
    )
    right = listed.join(slots, "key", "left").select(
        "key",
        F.explode(F.sequence(F.lit(0), of_key - 1)).alias("slot"),
        "at",
        F.lit(None).cast("string").alias("host"),
        "by",
    )
    past = (
        Window.partitionBy("key", "slot")
        .orderBy("at")
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        left.unionByName(right)
        .withColumn("by", F.last("by", ignorenulls=True).over(past))
        .where(F.col("host").isNotNull() & (F.size("by") > 0))
        .select("host", F.col("at").alias("fetched"), "by")
        .groupBy("host", "fetched")
        .agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("by")))).alias("blocked_by"))
    )


def filter_captures(
    captures: DataFrame, entries: DataFrame, lists: list[str] | None = None
) -> DataFrame:
    """``captures`` with blocked_by (listed keys in force at its fetch, empty if none), as the last column.

    A capture's own column of that name stays; the new one's then ends in an underscore more.
    """
    verdict = active_entries(captures, entries, lists)
    row = F.struct(*[column_ref(c) for c in captures.columns])
    asked = captures.select(
        row.alias("row"), host_of(F.col("url")).alias("host"), F.col("fetched").alias("fetched")
    )
    none = F.array().cast("array<string>")
    found = F.coalesce("blocked_by", none).alias(free_name("blocked_by", captures.columns))
    return asked.join(verdict, ["host", "fetched"], "left").select("row.*", found)


def dated_entries(pages: DataFrame, url: str = "url") -> DataFrame:
    """List entries derived from the hosts of a crawl, for tables that come without lists.

    Every host and parent domain gets, by the digest of its name, a place in at most one
    of the lists ads, adult and malware, dates of listing and of removal, and for some a
    second listing.
    """
    hosts = pages.select(F.explode(keys_of(host_of(F.col(url)))).alias("key")).distinct()
    digest = F.md5("key")
    part = lambda i: F.conv(F.substring(digest, i, 4), 16, 10).cast("int")
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n)
    rows = hosts.select("key", once(F.struct(*[part(1 + 4 * i).alias(f"h{i}") for i in range(5)])))
    kind = F.element_at(
        F.array(F.lit("ads"), F.lit("adult"), F.lit("malware")), (F.col("h0") % 3 + 1).cast("int")
    )
    first, second = F.col("h1") % 200, F.col("h2") % 120 + 1
    return rows.where(F.col("h0") % 10 < 4).select(
        kind.alias("list"),
        "key",
        F.inline(
            F.array(
                F.struct(day(first).alias("at"), F.lit("add").alias("action")),
                F.struct(
                    F.when(F.col("h3") % 4 > 0, day(first + second)).alias("at"),
                    F.lit("remove").alias("action"),
                ),
                F.struct(
                    F.when(F.col("h4") % 2 > 0, day(first + second + 40)).alias("at"),
                    F.lit("add").alias("action"),
                ),
            )
        ),
    )
