"""URL filters by dated lists: validity intervals, joined to captures as of their time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roadprep.llm.scratch import settled

#: Intervals up to which the list is broadcast; beyond it the join shuffles both sides by key, hot keys apart (see shuffled_hits).
BROADCAST_INTERVALS = 200_000
#: A key of more than one in HOT_KEYS captures is hot: at most HOT_KEYS times the keys of one capture are. Its captures and
#: intervals are dealt over SALTS tasks.
HOT_KEYS, SALTS = 1_000, 256
#: What is added to the number of a prefix's segments, and the weight of a URL: more than a host has labels or a path segments.
PREFIX_WEIGHT = 1 << 29
URL_WEIGHT = 1 << 30


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and a final dot; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    host = F.regexp_replace(host, r"\.$", "")
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    """Path without query and fragment, `/` if empty."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", F.lit("/")).otherwise(path)


def intervals(entries: DataFrame) -> DataFrame:
    """list, action, kind, value, valid_from, valid_to from dated entries (list, action, kind, value, day, change).

    `change` is 'add' or 'remove'. An entry is valid from an addition to the next removal, the end exclusive, null if
    open; an addition while it is valid and a removal while it is not change nothing. Of several changes on a day the
    removal comes last. Rows with a null in a key or the day, or another change, are not part of the list.
    """
    keys = ["list", "action", "kind", "value"]
    entries = entries.select(*keys, "day", "change").filter(F.col("change").isin("add", "remove")).dropna()
    entries = entries.groupBy(*keys, "day").agg(F.max(F.col("change") == "remove").alias("off"))
    w = Window.partitionBy(*keys).orderBy("day")
    entries = entries.withColumn("before", F.lag("off", 1, True).over(w)).filter(F.col("off") != F.col("before"))
    entries = entries.withColumn("valid_to", F.lead("day").over(w)).filter(~F.col("off"))
    return entries.select(*keys, F.col("day").alias("valid_from"), "valid_to")


def keys_of(url: Column, labels_at_most: int | None = None, segments_at_most: int | None = None) -> Column:
    """What a URL is looked up by: (kind, value, weight) for each end of its host, each beginning of its path, itself.

    Weights order specificity: domains by labels, then path prefixes (host and whole segments), then the exact URL.
    Longer ends and beginnings than the list's longest entries can be left out (see longest_entries); all without.
    """
    host, path = host_of(url), path_of(url)
    none = F.array().cast("array<int>")

    def counted(n: Column, most: int | None) -> Column:
        n = n if most is None else F.least(n, F.lit(most))
        return F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(none)

    labels = F.split(host, r"\.")
    n = F.size(labels)
    domains = F.transform(counted(n, labels_at_most), lambda k: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, n - k + 1, k), ".").alias("value"), k.cast("int").alias("weight")))
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    prefixes = F.transform(
        counted(F.size(segments), segments_at_most),
        lambda k: F.struct(F.lit("prefix").alias("kind"), F.concat(host, F.lit("/"), F.array_join(F.slice(segments, 1, k), "/")).alias("value"), (F.lit(PREFIX_WEIGHT) + k).cast("int").alias("weight")),
    )
    exact = F.array(F.struct(F.lit("url").alias("kind"), url.alias("value"), F.lit(URL_WEIGHT).alias("weight")))
    return F.when(host.isNotNull(), F.concat(domains, prefixes, exact)).otherwise(exact)


def longest_entries(lists: DataFrame) -> tuple[int, int]:
    """Most labels of a domain entry and most segments of a prefix entry: a key with more parts equals no entry."""

    def most(kind: str, parts: Column) -> Column:
        return F.coalesce(F.max(F.when(F.col("kind") == kind, parts)), F.lit(0)).cast("int")

    row = lists.agg(most("domain", F.size(F.split("value", r"\."))), most("prefix", F.size(F.split("value", "/")) - 1)).first()
    return row[0], row[1]


def shuffled_hits(keyed: DataFrame, lists: DataFrame, captures: int) -> DataFrame:
    """keyed joined to lists by kind and value where neither side can be broadcast.

    Hot keys are counted (combined before the shuffle) and looked up in the list. Captures of those without an entry, as
    `com` mostly is, go before the join; those with one are salted, and their intervals repeated for each salt. Only the
    hot keys are broadcast, whose number HOT_KEYS bounds.
    """
    keys = ["kind", "value"]
    hot = keyed.groupBy(*keys).count().filter(F.col("count") * HOT_KEYS > captures).select(*keys)
    held = lists.join(F.broadcast(hot), keys, "left_semi").groupBy(*keys).agg(F.lit(True).alias("_held"))
    hot = settled(hot.join(held, keys, "left").select(*keys, F.coalesce("_held", F.lit(False)).alias("_held")))
    salt = F.pmod(F.xxhash64("_id", "_url", "_time"), F.lit(SALTS)).cast("int")
    left = keyed.join(F.broadcast(hot), keys, "left").filter("_held IS NULL OR _held").withColumn("_salt", F.when(F.col("_held"), salt).otherwise(0)).drop("_held")
    salts = F.when(F.col("_held"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = lists.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(salts)).drop("_held")
    return left.join(right, [*keys, "_salt"]).drop("_salt")


def filter_captures(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """id_col, url, fetched, n_matches, allowed, matched for each capture, by the entries valid when it was fetched.

    `matched` is "action:kind:value" of the decisive entry: the most specific one, 'allow' before 'block' of equal ones,
    then the smallest value; null if none matches. `allowed` is false if that entry blocks. A null URL or time matches
    nothing and is allowed. A capture is its id, URL and time, nulls included; repeated rows give equal rows, no captures
    none; other columns are not read. `entries` as for `intervals`.
    """
    lists = settled(intervals(entries))
    small = lists.limit(BROADCAST_INTERVALS + 1).count() <= BROADCAST_INTERVALS
    rows = captures.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(time_col).alias("_time"))
    keyed = rows.filter("_url IS NOT NULL AND _time IS NOT NULL").distinct().select("*", F.explode(keys_of(F.col("_url"), *longest_entries(lists))).alias("k")).select("_id", "_url", "_time", "k.kind", "k.value", "k.weight")
    hits = keyed.join(F.broadcast(lists), ["kind", "value"]) if small else shuffled_hits(keyed, lists, rows.count())
    hits = hits.filter((F.col("_time") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("_time") < F.col("valid_to"))))
    name = F.concat_ws(":", "action", "kind", "value")
    best = F.struct((-F.col("weight")).alias("w"), (F.col("action") != "allow").alias("b"), name.alias("name"))
    verdict = hits.groupBy("_id", "_url", "_time").agg(F.count("*").alias("n"), F.min(best).alias("best"))
    verdict = verdict.toDF("_i", "_u", "_t", "n", "best")
    joined = rows.join(verdict, rows["_id"].eqNullSafe(verdict["_i"]) & (rows["_url"] == verdict["_u"]) & (rows["_time"] == verdict["_t"]), "left")
    return joined.select(
        F.col("_id").alias(id_col),
        F.col("_url").alias("url"),
        F.col("_time").alias("fetched"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_matches"),
        F.coalesce(~F.col("best.b"), F.lit(True)).alias("allowed"),
        F.col("best.name").alias("matched"),
    )


def derived_captures(pages: DataFrame) -> DataFrame:
    """page_id, url and a fetch day for each page: the table has no time, so one year is dealt out by page_id."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(365)).cast("int")).alias("fetched"))


def derived_entries(pages: DataFrame) -> DataFrame:
    """Dated entries made of the pages' own hosts and paths, which a list would hold.

    Hosts whose MD5 begins with 0 to 5 are blocked, from a day and for a time that the hash gives, and again later;
    their paths /en are allowed from day 60; every host under `example.net` is blocked from day 200.
    """
    hosts = pages.select(host_of(F.col("url")).alias("value")).filter("value IS NOT NULL").distinct().withColumn("h", F.md5("value"))
    day = F.conv(F.substring("h", 2, 2), 16, 10).cast("int")
    start = F.lit("2024-01-01").cast("date")
    bad = hosts.filter(F.substring("h", 1, 1) <= "5")
    changes = [("add", day), ("add", day + 5), ("remove", day + 40), ("add", day + 90)]
    parts = [bad.select(F.lit("abuse").alias("list"), F.lit("block").alias("action"), F.lit("domain").alias("kind"), "value", F.date_add(start, n).alias("day"), F.lit(c).alias("change")) for c, n in changes]
    parts.append(bad.select(F.lit("review"), F.lit("allow"), F.lit("prefix"), F.concat("value", F.lit("/en")), F.date_add(start, F.lit(60)), F.lit("add")))
    zone = hosts.filter(F.col("value").endswith(".example.net"))
    parts.append(zone.select(F.lit("zone"), F.lit("block"), F.lit("domain"), F.lit("example.net"), F.date_add(start, F.lit(200)), F.lit("add")).distinct())
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def url_report(pages: DataFrame) -> DataFrame:
    """filter_captures over the whole table, with the fetch day as text."""
    return filter_captures(derived_captures(pages), derived_entries(pages)).withColumn("fetched", F.col("fetched").cast("string"))
