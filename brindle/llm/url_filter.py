"""URL filters by a temporal join with dated lists, in DataFrame and SQL functions only.

List entries are dated: an entry adds or removes a pattern on a day. Per list and pattern, an addition holds from its day
until the next entry: a validity interval. Every capture is checked against the entries that were in force on the day
it was fetched (an as-of join): it is keyed by the suffixes of its host and the prefixes of its path, which meet the
patterns by equality, then the interval must contain the day. Keys have no more labels and no more path segments than
the list's longest patterns, so a very long url has no more keys than others. Of the entries that hold, the longest
pattern wins; of equally long ones an allowing entry, then the first list by name.

The intervals are broadcast only if they are counted and few; else both sides are shuffled by key, where Spark can split
a host that holds a large share of the captures, since each capture is put together again by its own row number. The
numbered captures are stored first, so that a task that runs again finds the same numbers.

Nulls and edge cases: a capture with null url, host or day meets no entry and passes; entries with null pattern, day or
action are ignored; of entries of one list, pattern and day, a removal counts; repeated captures give repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm.common import stored, table

FEW = 100_000  # intervals that may be broadcast

#: List entries of the registered query: (list, verdict, pattern, action, day).
ENTRIES = (
    ("gambling", "block", "casino-win.example.com", "add", "2024-01-15"),
    ("gambling", "block", "casino-win.example.com", "remove", "2024-09-01"),
    ("gambling", "block", "casino-win.example.com", "add", "2025-02-01"),
    ("gambling", "block", "free-bets.example.com", "add", "2024-03-10"),
    ("pharmacy", "block", "cheap-pills.example.com", "add", "2023-11-05"),
    ("pharmacy", "block", "cheap-pills.example.com", "remove", "2025-06-30"),
    ("pharmacy", "allow", "www.cheap-pills.example.com/de", "add", "2024-05-20"),
    ("tracking", "block", "m.casino-win.example.com", "add", "2024-07-01"),
    ("tracking", "block", "example.net/de", "add", "2024-10-10"),
    ("trusted", "allow", "blog.free-bets.example.com", "add", "2024-06-01"),
    ("trusted", "allow", "example.org", "add", "2024-01-01"),
    ("trusted", "allow", "example.org", "remove", "2024-12-24"),
)


def intervals(entries: DataFrame) -> DataFrame:
    """(list, verdict, pattern, start, stop) of entries (list, verdict, pattern, action, day); stop is exclusive, null if open."""
    known = entries.where("pattern is not null and day is not null and action in ('add', 'remove')")
    daily = known.groupBy("list", "pattern", "day").agg(F.max("action").alias("action"), F.min("verdict").alias("verdict"))
    following = F.lead("day").over(Window.partitionBy("list", "pattern").orderBy("day"))
    return daily.select("list", "verdict", "pattern", F.col("day").alias("start"), following.alias("stop"), "action").where("action = 'add'").drop("action")


_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
_PATH = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^?#]*)"


def host_of(url) -> F.Column:
    return F.nullif(F.lower(F.regexp_extract(url, _HOST, 1)), F.lit(""))


def keys_of(host: str, path: str, labels: int, segments: int) -> str:
    """SQL: the suffixes of the host at dots of up to so many labels, each also with the prefixes of the path at slashes of up to so many segments."""
    ends = f"transform(array(split({host}, '[.]')), h -> transform(sequence(greatest(size(h) - {labels}, 0) + 1, size(h)), i -> array_join(slice(h, i, size(h)), '.')))[0]"
    parts = f"slice(filter(split({path}, '/', {segments} + 64), x -> x <> ''), 1, {segments})"
    # empty segments are passed over; only a path with very many of them is split whole
    parts = f"if(size(split({path}, '/', {segments} + 64)) < {segments} + 64, {parts}, slice(filter(split({path}, '/'), x -> x <> ''), 1, {segments}))"
    prefixes = f"transform(array({parts}), p -> transform(sequence(0, size(p)), i -> if(i = 0, '', concat('/', array_join(slice(p, 1, i), '/')))))[0]"
    return f"array_distinct(flatten(transform({ends}, s -> transform({prefixes}, x -> concat(s, x)))))"


def filtered(captures: DataFrame, entries: DataFrame, url: str = "url", day: str = "fetched") -> DataFrame:
    """captures with host, verdict (block, allow or pass), list and pattern; columns of these names are replaced. Select the columns that are needed first."""
    captures = captures.drop("host", "verdict", "list", "pattern")
    held = intervals(entries).withColumnRenamed("pattern", "_pattern")
    host, path = F.split(F.col("_pattern"), "/")[0], F.split(F.col("_pattern"), "/")
    labels, segments, count = held.agg(F.max(F.size(F.split(host, "[.]"))), F.max(F.size(path) - 1), F.count(F.lit(1))).first()
    if count <= FEW:
        held = F.broadcast(held)
    row = captures.select(F.monotonically_increasing_id().alias("_row"), F.struct(*captures.columns).alias("_capture"), F.col(day).alias("_day"), host_of(F.col(url)).alias("_host"), F.regexp_extract(url, _PATH, 1).alias("_path"))
    may = F.col("_host").isNotNull() & F.col("_day").isNotNull()
    keyed = stored(row).withColumn("_key", F.explode_outer(F.when(may, F.expr(keys_of("_host", "_path", labels or 0, segments or 0)))))
    met = keyed.join(held, (F.col("_key") == F.col("_pattern")) & (F.col("_day") >= F.col("start")) & (F.col("stop").isNull() | (F.col("_day") < F.col("stop"))), "left")
    rank = F.when(F.col("_pattern").isNotNull(), F.struct((-F.length("_pattern")).alias("size"), "verdict", "list", F.col("_pattern").alias("pattern")))
    best = met.groupBy("_row").agg(F.first("_capture").alias("_capture"), F.first("_host").alias("host"), F.min(rank).alias("_best"))
    return best.select("_capture.*", "host", F.coalesce("_best.verdict", F.lit("pass")).alias("verdict"), F.col("_best.list").alias("list"), F.col("_best.pattern").alias("pattern"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page against the lists in force on its day; the table has no dates, so a page's day follows from its id."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.expr("date_add(date'2024-01-01', int(page_id * 13 % 730))").alias("fetched"))
    entries = spark.sql(f"SELECT * FROM VALUES {_VALUES} AS e(list, verdict, pattern, action, day)")
    return filtered(pages, entries)


QUERIES = {"op1_url_filter": op1_url_filter}

_VALUES = ", ".join(f"('{a}', '{b}', '{c}', '{d}', DATE '{e}')" for a, b, c, d, e in ENTRIES)
ORACLE_SQL = {
    "op1_url_filter": rf"""
WITH e(list, verdict, pattern, action, day) AS (VALUES {_VALUES}),
iv AS (SELECT * FROM (SELECT list, verdict, pattern, action, day AS start, lead(day) OVER (PARTITION BY list, pattern ORDER BY day) AS stop FROM e) WHERE action = 'add'),
c AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST(page_id * 13 % 730 AS INTEGER) AS fetched,
         nullif(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '') AS host,
         regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) AS path
  FROM pages
), m AS (
  SELECT page_id, iv.list, iv.verdict, iv.pattern, row_number() OVER (PARTITION BY page_id ORDER BY length(iv.pattern) DESC, iv.verdict, iv.list) AS r
  FROM c JOIN iv ON fetched >= start AND (stop IS NULL OR fetched < stop)
   AND ends_with('.' || host, '.' || split_part(iv.pattern, '/', 1))
   AND (NOT contains(iv.pattern, '/') OR starts_with(path || '/', '/' || split_part(iv.pattern, '/', 2) || '/'))
)
SELECT c.page_id, url, fetched, host, coalesce(m.verdict, 'pass') AS verdict, m.list, m.pattern
FROM c LEFT JOIN m ON m.page_id = c.page_id AND r = 1
"""
}
