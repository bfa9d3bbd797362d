"""URL filters with dated lists: a temporal join of captures with list entries.

List entries are dated: a pattern is added to a list and may be removed and added again. The entries
of a pattern become validity intervals, and each capture is evaluated as of its fetch time against
the intervals of all patterns that cover its URL. Patterns are hosts, domains (a host and all below
it) and paths (``host/segment/...`` and all below). Hosts are compared in lower case, paths as they
are; slashes at the end of a pattern and doubled ones mean nothing.

A capture becomes one key for each pattern that could cover it, and keys are joined with the distinct
listed patterns by equality, so no pair of a capture and a foreign pattern is ever made. Paths give
keys only down to the deepest listed pattern, which loses nothing. Then an as-of pick: captures and the
pattern's turns (on or off) are put in one order of time, and a capture takes the last turn before it,
so a pattern that was toggled many times costs a capture no more than another. A pattern that covers
many captures is dealt over salts by their counted number, and its turns go to each of them.

Patterns are broadcast if they are few; otherwise the join is shuffled and Spark splits hot keys of
it (one row of a pattern against many captures).

Edge cases: a null or malformed url (also one whose host has over 127 labels, more than a host name can
have) has no keys and is never listed; a null id is an id; a null fetch time is covered by no interval; an add and a remove at one instant leave the pattern listed; repeated entries count
once, repeated captures give repeated rows; empty tables give empty results or unlisted captures;
other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deltaweave.llm.literals import table
from deltaweave.session import materialize

MAX_SENT_PATTERNS = 500_000
#: Captures of one pattern that one task orders by time.
ROWS_PER_SALT = 100_000
ENTRY = ("list", "kind", "pattern")
#: A capture: its id, fetch time and a hash of its URL.
ROW = ("id", "_t", "_u")

#: A host has at most 253 characters (RFC 1035), so at most 127 labels; longer ones are malformed.
MAX_LABELS = 127
#: 1 January 2024, where fetch times and derived entries begin.
YEAR = 1704067200

#: Entries of the lists that the query evaluates: (list, kind, pattern, action, date).
ENTRIES = (
    ("spam", "domain", "spam-farm.example.org", "add", "2024-02-01 00:00:00"),
    ("spam", "domain", "spam-farm.example.org", "remove", "2024-07-01 00:00:00"),
    ("spam", "domain", "spam-farm.example.org", "add", "2024-10-01 00:00:00"),
    ("spam", "domain", "cheap-pills.example.com", "add", "2023-06-01 00:00:00"),
    ("spam", "host", "m.free-bets.example.com", "add", "2024-03-10 06:30:00"),
    ("gambling", "domain", "free-bets.example.com", "add", "2024-05-15 12:00:00"),
    ("gambling", "domain", "free-bets.example.com", "add", "2024-06-15 12:00:00"),
    ("gambling", "domain", "free-bets.example.com", "remove", "2024-11-01 00:00:00"),
    ("gambling", "domain", "free-bets.example.com", "remove", "2024-11-02 00:00:00"),
    ("optout", "path", "Tionsh.example.net//en/", "add", "2024-03-01 00:00:00"),
    ("optout", "path", "tionsh.example.net/en", "remove", "2024-09-01 00:00:00"),
    ("optout", "host", "blog.tionsh.example.net", "add", "2024-08-01 00:00:00"),
)


def entries(spark: SparkSession, rows: tuple = ENTRIES) -> DataFrame:
    """(list, kind, pattern, action, at) from literal rows."""
    return table(spark, rows, "list string, kind string, pattern string, action string, at timestamp")


def normal(kind: Column, pattern: Column) -> Column:
    """The pattern as keys are written: host in lower case, path as it is without needless slashes."""
    folded = F.regexp_replace(F.regexp_replace(pattern, "/+", "/"), "/$", "")
    first = F.regexp_extract(folded, "^[^/]*", 0)
    return F.when(kind == "path", F.concat(F.lower(first), F.regexp_replace(folded, "^[^/]*", ""))).otherwise(F.lower(folded))


def turns(listed: DataFrame) -> DataFrame:
    """(list, kind, pattern, at, on): the instants where a pattern's state changes, from unlisted."""
    known = listed.where("pattern is not null and at is not null").select("list", "kind", normal(F.col("kind"), F.col("pattern")).alias("pattern"), "at", (F.col("action") == "add").alias("on"))
    known = known.groupBy(*ENTRY, "at").agg(F.max("on").alias("on"))
    was = F.lag("on", 1, False).over(Window.partitionBy(*ENTRY).orderBy("at"))
    return known.withColumn("was", was).where("was <> on").select(*ENTRY, "at", "on")


def intervals(listed: DataFrame) -> DataFrame:
    """(list, kind, pattern, since, until): half-open; until is null while the entry stands."""
    until = F.lead("at").over(Window.partitionBy(*ENTRY).orderBy("at"))
    return turns(listed).withColumn("until", until).where("on").select(*ENTRY, F.col("at").alias("since"), "until")


def host(url: Column) -> Column:
    """Lower-case host without user, port and final dot; empty if there is none."""
    return F.regexp_replace(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), r"\.$", "")


def path(url: Column) -> Column:
    """Path without query and fragment, without the slashes at its ends."""
    return F.regexp_replace(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/([^?#]*)", 1), r"^/+|/+$", "")


def keys(url: Column, deepest: int) -> Column:
    """Array of (kind, pattern) that would cover the URL, with paths of up to ``deepest`` segments."""
    h, labels, segments = host(url), F.split(host(url), r"\."), F.split(path(url), "/+")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.lit("domain").alias("kind"), F.concat_ws(".", F.slice(labels, i, F.size(labels))).alias("pattern")))
    paths = F.transform(F.sequence(F.lit(0), F.least(F.size(segments), F.lit(deepest))), lambda i: F.struct(F.lit("path").alias("kind"), F.concat_ws("/", F.array(h), F.slice(segments, 1, i)).alias("pattern")))
    own = F.array(F.struct(F.lit("host").alias("kind"), h.alias("pattern")))
    return F.when((h != "") & (F.size(labels) <= MAX_LABELS), F.array_distinct(F.concat(own, domains, paths)))


def candidates(captures: DataFrame, changes: DataFrame, max_sent: int = MAX_SENT_PATTERNS) -> DataFrame:
    """(id, _t, _u, list, kind, pattern): each capture with the listed patterns that cover its URL, at whatever time."""
    patterns = changes.select(*ENTRY).distinct()
    found = patterns.agg(F.count("*").alias("n"), F.max(F.when(F.col("kind") == "path", F.size(F.split("pattern", "/")) - 1)).alias("deepest")).first()
    spread = captures.where("fetched_at is not null").select("id", F.col("fetched_at").alias("_t"), F.xxhash64("url").alias("_u"), F.explode(keys(F.col("url"), found["deepest"] or 0)).alias("_k")).select(*ROW, "_k.kind", "_k.pattern")
    return spread.join(F.broadcast(patterns) if found["n"] <= max_sent else patterns, ["kind", "pattern"]).select(*ROW, *ENTRY)


def matches(captures: DataFrame, listed: DataFrame, max_sent: int = MAX_SENT_PATTERNS, per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """(id, _t, _u, list, kind, pattern) for every entry that stands at the capture's fetch time; equal captures count once."""
    changes = materialize(turns(listed), "turns")
    met = materialize(candidates(captures, changes, max_sent).distinct(), "candidates")
    salts = materialize(met.groupBy(*ENTRY).agg(F.ceil(F.count("*") / per_salt).cast("int").alias("_salts")), "salts")  # a row for each pattern that is met
    sent = F.broadcast(salts) if salts.count() <= max_sent else salts
    asks = met.join(sent, [*ENTRY]).select(*ENTRY, F.pmod(F.xxhash64(*ROW), "_salts").cast("int").alias("_salt"), F.col("_t").alias("at"), F.lit(1).alias("_ask"), "id", "_u", F.lit(None).cast("boolean").alias("on"))
    told = changes.join(sent, [*ENTRY]).select(*ENTRY, F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"), "at", F.lit(0).alias("_ask"), F.lit(None).cast(dict(met.dtypes)["id"]).alias("id"), F.lit(None).cast("long").alias("_u"), "on")
    state = F.last("on", ignorenulls=True).over(Window.partitionBy(*ENTRY, "_salt").orderBy("at", "_ask").rowsBetween(Window.unboundedPreceding, 0))
    return told.unionByName(asks).withColumn("_state", state).where("_ask = 1 and _state").select("id", F.col("at").alias("_t"), "_u", *ENTRY)


def evaluate(captures: DataFrame, listed: DataFrame, id_col: str = "id", max_sent: int = MAX_SENT_PATTERNS, per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """id, blocked, lists (names in order, joined by commas), n_entries for every capture (id, url, fetched_at)."""
    numbered = captures.select(F.col(id_col).alias("id"), F.col("url").cast("string").alias("url"), F.col("fetched_at"))
    found = matches(numbered, listed, max_sent, per_salt)
    # the lists are few and their names distinct, so the set is bounded by the lists, not the rows
    per = found.groupBy(*ROW).agg(F.concat_ws(",", F.sort_array(F.collect_set("list"))).alias("lists"), F.count("*").alias("n_entries")).withColumnRenamed("id", "_id")
    own = F.col("id").eqNullSafe(F.col("_id")) & (F.col("fetched_at") == F.col("_t")) & (F.xxhash64("url") == F.col("_u"))
    return numbered.join(per, own, "left").select("id", F.col("n_entries").isNotNull().alias("blocked"), F.coalesce("lists", F.lit("")).alias("lists"), F.coalesce("n_entries", F.lit(0).cast("long")).alias("n_entries"))


def seen_entries(pages: DataFrame) -> DataFrame:
    """Dated entries for what a crawl has seen, chosen by digits of an MD5.

    Every host is under review for 15 days of each 60, from a day of its own on; one domain in five is
    spam from some day on, two thirds of them for 30 to 89 days; one first path segment in four has opted out.
    """
    seen = pages.select(host(F.col("url")).alias("h"), F.regexp_extract(path(F.col("url")), "^[^/]*", 0).alias("s")).where("h <> ''").distinct()
    number = lambda c: F.conv(F.substring(F.md5(c), 1, 4), 16, 10).cast("int")
    day = lambda d: F.timestamp_seconds(F.lit(YEAR) + d * 86400)

    def entry(kind: str, of: DataFrame, name: str, action: str, at: Column) -> DataFrame:
        return of.select(F.lit(name).alias("list"), F.lit(kind).alias("kind"), "pattern", F.lit(action).alias("action"), day(at).alias("at"))

    hosts = seen.select(F.col("h").alias("pattern")).distinct().withColumn("m", number(F.col("pattern")))
    paths = seen.where("s <> ''").select(F.concat("h", F.lit("/"), "s").alias("pattern")).distinct().withColumn("m", number(F.col("pattern"))).where("m % 4 = 0")
    rounds = hosts.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(5))))
    spam = hosts.where("m % 5 = 0")
    m, k = F.col("m"), F.col("k")
    parts = (
        entry("host", rounds, "review", "add", m % 45 + 60 * k), entry("host", rounds, "review", "remove", m % 45 + 60 * k + 15), entry("domain", spam, "spam", "add", m % 300),
        entry("domain", spam.where("m % 3 <> 0"), "spam", "remove", m % 300 + 30 + m % 60), entry("path", paths, "optout", "add", m % 365),
    )
    return reduce(DataFrame.unionByName, parts)


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` as captures, with fetch times spread over 2024 by the page's number."""
    at = F.timestamp_seconds(F.lit(YEAR) + (F.col("page_id") * 86413) % 31622400)
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", at.alias("fetched_at"))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page against the fixed entries and those of ``seen_entries``."""
    found = captures(spark, sf_dir)
    return evaluate(found, entries(spark).unionByName(seen_entries(found)), "page_id").withColumnRenamed("id", "page_id")


def _op1_sql() -> str:
    rows = ", ".join(f"('{a}', '{b}', '{c}', {d == 'add'}, TIMESTAMP '{e}')" for a, b, c, d, e in ENTRIES)
    number = "CAST('0x' || substr(md5(pattern), 1, 4) AS INTEGER) AS m"
    day = "TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST({} AS INTEGER))".format
    return f"""WITH c AS (SELECT page_id, TIMESTAMP '2024-01-01 00:00:00' + to_seconds((page_id * 86413) % 31622400) AS t, regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1) AS h,
 regexp_replace(trim(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/([^?#]*)', 1), '/'), '/+', '/', 'g') AS p FROM pages),
hosts AS (SELECT pattern, {number} FROM (SELECT DISTINCT h AS pattern FROM c WHERE h <> '')),
paths AS (SELECT pattern, {number} FROM (SELECT DISTINCT h || '/' || split_part(p, '/', 1) AS pattern FROM c WHERE h <> '' AND p <> '')),
raw AS (SELECT * FROM (VALUES {rows}) AS t(list, kind, pattern, o, ts)
 UNION ALL SELECT 'review', 'host', pattern, true, {day("m % 45 + 60 * k")} FROM hosts, range(6) r(k) UNION ALL SELECT 'review', 'host', pattern, false, {day("m % 45 + 60 * k + 15")} FROM hosts, range(6) r(k)
 UNION ALL SELECT 'spam', 'domain', pattern, true, {day("m % 300")} FROM hosts WHERE m % 5 = 0 UNION ALL SELECT 'spam', 'domain', pattern, false, {day("m % 300 + 30 + m % 60")} FROM hosts WHERE m % 5 = 0 AND m % 3 <> 0
 UNION ALL SELECT 'optout', 'path', pattern, true, {day("m % 365")} FROM paths WHERE m % 4 = 0),
e AS (SELECT list, kind, CASE kind WHEN 'path' THEN lower(regexp_extract(f, '^[^/]*')) || regexp_replace(f, '^[^/]*', '') ELSE lower(f) END AS pattern, ts, bool_or(o) AS o FROM (SELECT *, rtrim(regexp_replace(pattern, '/+', '/', 'g'), '/') AS f FROM raw) GROUP BY ALL),
s AS (SELECT *, lag(o) OVER w AS was FROM e WINDOW w AS (PARTITION BY list, kind, pattern ORDER BY ts)),
i AS MATERIALIZED (SELECT * FROM (SELECT list, kind, pattern, o, ts AS since, lead(ts) OVER (PARTITION BY list, kind, pattern ORDER BY ts) AS until FROM s WHERE was IS NULL OR was <> o) WHERE o),
u AS MATERIALIZED (SELECT DISTINCT h, p FROM c), l AS MATERIALIZED (SELECT DISTINCT kind, pattern FROM i),
k AS MATERIALIZED (SELECT DISTINCT u.h, u.p, l.kind, l.pattern FROM u JOIN l ON CASE kind WHEN 'host' THEN h = pattern WHEN 'domain' THEN h = pattern OR ends_with(h, '.' || pattern) ELSE h || '/' || p = pattern OR starts_with(h || '/' || p || '/', pattern || '/') END),
m AS (SELECT DISTINCT page_id, i.list, i.kind, i.pattern FROM c JOIN k USING (h, p) JOIN i ON i.kind = k.kind AND i.pattern = k.pattern AND i.since <= c.t AND (i.until IS NULL OR c.t < i.until))
SELECT c.page_id, count(m.list) > 0 AS blocked, coalesce(string_agg(DISTINCT m.list, ',' ORDER BY m.list), '') AS lists, count(m.list) AS n_entries FROM c LEFT JOIN m ON m.page_id = c.page_id GROUP BY c.page_id"""


OP1_SQL = _op1_sql()
