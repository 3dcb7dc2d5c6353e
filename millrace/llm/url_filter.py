"""URL lists through time: every capture is held against the entries active when it was fetched.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.work import Work

#: Of entries of one key and day, the last of these holds.
ACTIONS = ("remove", "allow", "block")
#: Copies of what is active for a key and a day.
SALTS = 16


def host_of(url: F.Column) -> F.Column:
    """Lower-cased host, without user, port and last dot; empty where there is none."""
    return F.regexp_replace(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)", 1), r"\.+$", "")


def host_keys(host: F.Column) -> F.Column:
    """The host and its parent domains, each with its number of labels."""
    labels = F.split(host, r"\.")
    size = F.size(labels)
    keys = F.transform(F.sequence(F.lit(1), size), lambda n: F.struct(F.array_join(F.slice(labels, -n, n), ".").alias("key"), n.alias("labels")))
    return F.when(host != "", keys).otherwise(F.array().cast("array<struct<key:string,labels:int>>"))


def intervals(entries: DataFrame) -> DataFrame:
    """(key, action, from_day, to_day): how long each of (key, action, listed_on) holds; to_day is null for the last."""
    rank = F.array_position(F.array(*map(F.lit, ACTIONS)), F.col("action"))
    day = entries.where("key is not null and listed_on is not null").groupBy("key", "listed_on").agg(F.max(F.struct(rank.alias("rank"), "action")).alias("last"))
    follow = F.lead("listed_on").over(Window.partitionBy("key").orderBy("listed_on"))
    spans = day.select("key", F.col("last.action").alias("action"), F.col("listed_on").alias("from_day"), follow.alias("to_day"))
    return spans.where("action <> 'remove'")


def listed_at_fetch(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", day_col: str = "fetched_on") -> DataFrame:
    """(page_id, host, fetched_on, verdict, list_key, listed_since) for every row of ``captures``.

    ``entries`` (key, action, listed_on) dates a host or domain onto the list with
    ``block`` or ``allow``, and off with ``remove``; each entry holds until the next of its
    key.  The as-of join takes for each of a capture's host and parent domains the
    entry that holds on the day of the fetch, the day it was listed included.  The
    most specific one decides; without any the verdict is ``none``.

    What holds depends on key and day alone, so captures are thinned to distinct hosts and
    days, and those to distinct keys and days, before anything is joined: a key that most captures share
    is as many rows as there are days, and a long history meets each day once.  What is then active
    is dealt to SALTS copies, so the hosts under one such key are spread over as many tasks.  List and
    captures grow alike, so neither is broadcast.

    Null or malformed URLs have an empty host, a null day meets no interval: ``none``.
    Very long URLs are read whole.  Null ids and repeated rows are reported like any other.  Empty
    tables give an empty result, or ``none`` throughout for an empty list.  Other columns are ignored,
    whatever their names.
    """
    work = Work(captures.sparkSession, "urls")
    rows = captures.select(F.col(id_col).alias("page_id"), host_of(F.coalesce(F.col(url_col), F.lit(""))).alias("host"), F.col(day_col).alias("fetched_on"))
    rows = work.keep(rows, "captures")
    spans = intervals(entries)
    visits = rows.where("host <> '' and fetched_on is not null").select("host", "fetched_on").distinct()
    asked = work.keep(visits.select("host", "fetched_on", F.explode(host_keys(F.col("host"))).alias("k")).select("host", "fetched_on", "k.key", "k.labels"), "asked")
    held = (F.col("fetched_on") >= F.col("from_day")) & (F.col("to_day").isNull() | (F.col("fetched_on") < F.col("to_day")))
    active = asked.select("key", "fetched_on").distinct().join(spans.hint("merge"), "key").where(held).select("key", "fetched_on", "action", "from_day")
    active = active.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = asked.withColumn("salt", F.pmod(F.xxhash64("host"), F.lit(SALTS)).cast("int"))
    best = salted.join(active.hint("merge"), ["key", "fetched_on", "salt"]).groupBy("host", "fetched_on").agg(F.max(F.struct("labels", "key", "action", "from_day")).alias("best"))
    return rows.join(best.hint("merge"), ["host", "fetched_on"], "left").select(
        "page_id",
        "host",
        "fetched_on",
        F.coalesce("best.action", F.lit("none")).alias("verdict"),
        F.col("best.key").alias("list_key"),
        F.col("best.from_day").alias("listed_since"),
    )


def _number(text: F.Column, of: int) -> F.Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 6), 16, 10).cast("int") % of


def dated_captures(pages: DataFrame) -> DataFrame:
    """``pages`` with a day of fetch by a rule on the URL, as the table has none."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), _number(F.coalesce("url", F.lit("")), 365)).alias("fetched_on"))


def dated_list(pages: DataFrame) -> DataFrame:
    """A list by a rule on the hosts of ``pages``: a third of hosts on, off and on again, a fifth of parent domains on, a quarter of hosts allowed."""
    host = pages.select(host_of(F.coalesce("url", F.lit(""))).alias("key")).where("key <> ''").distinct()
    parent = host.select(F.regexp_replace("key", r"^[^.]*\.", "").alias("key")).where(F.col("key").contains(".")).distinct()

    def on(keys: DataFrame, action: str, first: int, later: int) -> DataFrame:
        return keys.select("key", F.lit(action).alias("action"), F.date_add(F.lit("2024-01-01").cast("date"), _number(F.col("key"), first) + later).alias("listed_on"))

    third, quarter = host.where(_number(F.col("key"), 3) == 0), host.where(_number(F.col("key"), 4) == 1)
    fifth = parent.where(_number(F.col("key"), 5) == 0)
    parts = [on(third, "block", 200, 0), on(third, "remove", 200, 50), on(third, "block", 200, 120), on(quarter, "allow", 150, 10), on(fifth, "block", 100, 0)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


ORACLE = r"""
    WITH c AS (
        SELECT page_id, coalesce(url, '') AS url, regexp_replace(regexp_extract(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1), '\.+$', '') AS host,
               (DATE '2024-01-01' + CAST(('0x' || substr(md5(coalesce(url, '')), 1, 6)) AS INTEGER) % 365) AS fetched_on
        FROM pages),
    host AS (SELECT DISTINCT host AS key, CAST(('0x' || substr(md5(host), 1, 6)) AS INTEGER) AS h FROM c WHERE host <> ''),
    parent AS (SELECT DISTINCT regexp_replace(key, '^[^.]*\.', '') AS key FROM host),
    dom AS (SELECT key, CAST(('0x' || substr(md5(key), 1, 6)) AS INTEGER) AS h FROM parent WHERE contains(key, '.')),
    entries AS (
        SELECT key, 'block' AS action, 3 AS rank, DATE '2024-01-01' + h % 200 AS listed_on FROM host WHERE h % 3 = 0
        UNION ALL SELECT key, 'remove', 1, DATE '2024-01-01' + (h % 200 + 50) FROM host WHERE h % 3 = 0
        UNION ALL SELECT key, 'block', 3, DATE '2024-01-01' + (h % 200 + 120) FROM host WHERE h % 3 = 0
        UNION ALL SELECT key, 'allow', 2, DATE '2024-01-01' + (h % 150 + 10) FROM host WHERE h % 4 = 1
        UNION ALL SELECT key, 'block', 3, DATE '2024-01-01' + h % 100 FROM dom WHERE h % 5 = 0),
    asked AS (
        SELECT c.*, n AS labels, array_to_string(list_slice(string_split(host, '.'), -n, -1), '.') AS key
        FROM c, LATERAL (SELECT unnest(range(1, len(string_split(host, '.')) + 1)) AS n) WHERE host <> ''),
    latest AS (
        SELECT a.page_id, a.labels, a.key, e.action, e.listed_on,
               row_number() OVER (PARTITION BY a.page_id, a.key ORDER BY e.listed_on DESC, e.rank DESC) AS r
        FROM asked a JOIN entries e ON e.key = a.key AND e.listed_on <= a.fetched_on),
    best AS (
        SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY labels DESC) AS b FROM latest WHERE r = 1 AND action <> 'remove')
    SELECT c.page_id, c.host, CAST(c.fetched_on AS VARCHAR) AS fetched_on, coalesce(best.action, 'none') AS verdict, best.key AS list_key,
           CAST(best.listed_on AS VARCHAR) AS listed_since
    FROM c LEFT JOIN best ON best.page_id = c.page_id AND best.b = 1
"""
