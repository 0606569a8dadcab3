"""The registered queries and their DuckDB counterparts, over the library's operators.

Tables stand in for the media library's: orders are media in directories (customers), events a
time line, part a directory listing, documents searchable texts, embeddings image vectors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lensmill.functions import dates, features, hashes, maths, strings, vectors
from lensmill.operators import browse, cluster, dedup, merge, recommend, rollup, sessions, text_search, vector
from lensmill.plans import tasks
from lensmill.sources import codecs, scratch
from lensmill.sources.store import Store
from lensmill.sources.tables import table
from lensmill.streaming import live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None):
    """Registers a function under its name, with the SQL that gives the same rows."""

    def register(f):
        QUERIES[name or f.__name__] = f
        if oracle is not None:
            ORACLES[name or f.__name__] = oracle
        return f

    return register


def ms(column: str) -> Column:
    """Milliseconds of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {column})")


LOWER_SQL = f"'{strings.UPPER}', '{strings.LOWER}'"
ORDERS_NOW_SQL = "TIMESTAMP '2002-01-01 00:00:00'"


# --- browsing -------------------------------------------------------------------------------


@query(
    """SELECT o_custkey, count(*) AS media_count, (epoch_us(max(o_orderdate)) // 1000) AS latest_ms,
       arg_max(o_orderkey, (o_orderdate, -o_orderkey)) AS cover_path FROM orders GROUP BY o_custkey"""
)
def directory_summary(spark, sf):
    out = rollup.directory_summary(table(spark, sf, "orders"), "o_custkey", "o_orderdate", "o_orderkey")
    return out.select("o_custkey", "media_count", ms("latest_at").alias("latest_ms"), "cover_path")


@query(
    """WITH m AS (SELECT page_id, 'dir' || page_id % 40 AS dir, '/p/' || page_id || '.jpg' AS path, (page_id * 37) % 11 AS taken, CASE WHEN page_id % 3 = 0 THEN NULL ELSE 't' || page_id END AS thumb FROM pages)
       SELECT dir, count(*) AS media_count, max(taken) AS latest_at, arg_min(path, (-taken, path)) AS cover_path, arg_min({'t': thumb}, (-taken, path)).t AS cover_thumbnail FROM m GROUP BY dir"""
)
def directory_covers(spark, sf):
    key = F.col("page_id")
    rows = table(spark, sf, "pages").select(F.concat(F.lit("dir"), key % 40).alias("dir"), F.concat(F.lit("/p/"), key, F.lit(".jpg")).alias("path"), ((key * 37) % 11).alias("at"), F.when(key % 3 != 0, F.concat(F.lit("t"), key)).alias("thumb"))
    return rollup.directory_summary(rows, "dir", "at", "path", "thumb")


@query('SELECT user_id, strftime(ts, \'%Y-%m-%d\') AS "day", count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY strftime(ts, \'%Y-%m-%d\') DESC) - 1 AS place FROM events GROUP BY 1, 2')
def album_days(spark, sf):
    return rollup.by_day(table(spark, sf, "events"), "user_id", "ts").withColumn("day", F.col("day").cast("string"))


PART = browse.Media(path="p_partkey", name="p_name", directory="p_brand", kind="p_type", captured="p_size", modified="p_retailprice", size="p_retailprice", trashed=None)
SORT_SQL = {"NAME": f"translate(p_name, {LOWER_SQL})", "DATE": "p_size", "MODIFIED": "p_retailprice", "SIZE": "p_retailprice"}


def _browse(sort: str):
    what, way = sort.split("_")
    last = "DESC" if sort == "NAME_DESC" else "ASC"

    @query(
        f"SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY {SORT_SQL[what]} {way}, p_partkey {last}) - 1 AS place FROM part",
        name=f"directory_browse_{sort.lower()}",
    )
    def run(spark, sf):
        return browse.places(table(spark, sf, "part"), browse.sort_keys(sort, PART), "p_brand").select("p_brand", "p_partkey", "place")


for _sort in browse.SORTS:
    _browse(_sort)


@query("SELECT p_partkey, p_name FROM part WHERE p_brand = 'Brand#2' AND p_type = 'SMALL' ORDER BY p_size DESC, p_partkey LIMIT 20")
def directory_page(spark, sf):
    rows = browse.in_directory(table(spark, sf, "part"), PART, "Brand#2", "SMALL")
    return browse.page(rows, browse.sort_keys("DATE_DESC", PART), 20).select("p_partkey", "p_name")


def _timeline() -> list[tuple[Column, bool]]:
    return [(F.col("ts"), True), (F.col("event_id"), False)]


@query("SELECT event_id, (epoch_us(ts) // 1000) AS ts_ms FROM events ORDER BY ts DESC, event_id LIMIT 50")
def timeline_page(spark, sf):
    return browse.page(table(spark, sf, "events"), _timeline(), 50).select("event_id", ms("ts").alias("ts_ms"))


@query("SELECT event_id, (epoch_us(ts) // 1000) AS ts_ms FROM events WHERE ts < TIMESTAMP '2024-01-15 00:00:00' OR (ts = TIMESTAMP '2024-01-15 00:00:00' AND event_id > 0) ORDER BY ts DESC, event_id LIMIT 50")
def timeline_keyset(spark, sf):
    cursor = [F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"), 0]
    return browse.page(table(spark, sf, "events"), _timeline(), 50, cursor).select("event_id", ms("ts").alias("ts_ms"))


@query("SELECT event_id FROM events ORDER BY ts DESC, event_id LIMIT 50 OFFSET 200")
def timeline_offset_page(spark, sf):
    return browse.offset_page(table(spark, sf, "events"), _timeline(), 50, 200).select("event_id")


@query("SELECT count(*) AS \"offset\" FROM events WHERE ts > TIMESTAMP '2024-01-15 00:00:00' OR (ts = TIMESTAMP '2024-01-15 00:00:00' AND event_id < 100)")
def timeline_offset(spark, sf):
    return browse.offset_of(table(spark, sf, "events"), _timeline(), [F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"), 100])


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) - 1 AS place FROM events")
def viewer_places(spark, sf):
    return browse.places(table(spark, sf, "events"), _timeline(), "user_id").select("user_id", "event_id", "place")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE (l_shipdate, l_orderkey, l_linenumber) > (TIMESTAMP '1998-01-01', 100, 2) ORDER BY l_shipdate, l_orderkey, l_linenumber LIMIT 100")
def composite_keyset(spark, sf):
    keys = [(F.col("l_shipdate"), False), (F.col("l_orderkey"), False), (F.col("l_linenumber"), False)]
    cursor = [F.lit("1998-01-01 00:00:00").cast("timestamp_ntz"), 100, 2]
    return browse.page(table(spark, sf, "lineitem"), keys, 100, cursor).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31'")
def date_range(spark, sf):
    low, high = (F.lit(x).cast("timestamp_ntz") for x in ("1996-01-01 00:00:00", "1996-12-31 00:00:00"))
    return browse.between(table(spark, sf, "orders"), "o_orderdate", low, high).select("o_orderkey", "o_custkey")


@query(f"SELECT p_partkey FROM part WHERE translate(p_name, {LOWER_SQL}) LIKE '%red%' OR translate(p_brand, {LOWER_SQL}) LIKE '%red%' OR translate(p_type, {LOWER_SQL}) LIKE '%red%'")
def like_search(spark, sf):
    return table(spark, sf, "part").filter(strings.like_any("Red", F.col("p_name"), F.col("p_brand"), F.col("p_type"))).select("p_partkey")


@query("SELECT DISTINCT p_brand AS model FROM part WHERE p_brand IS NOT NULL")
def distinct_models(spark, sf):
    return table(spark, sf, "part").select(F.col("p_brand").alias("model")).filter("model is not null").distinct()


@query("SELECT o_orderkey FROM orders WHERE (epoch_us(o_orderdate) // 1000) > 0 AND (epoch_us(o_orderdate) // 1000) <= 946684800000 - 30 * 86400000::BIGINT")
def expired_trash(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", ms("o_orderdate").alias("deletedAtMs"))
    return browse.expired(rows, "deletedAtMs", 946_684_800_000).select("o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (17, 3, 99, 5)")
def explicit_paths(spark, sf):
    rows = table(spark, sf, "orders").withColumn("path", F.col("o_orderkey").cast("string"))
    return browse.by_paths(rows, "path", ["17", "3", " ", "99", "17", "5"]).select("o_orderkey", "o_totalprice")


@query(
    """SELECT 'scene' AS filter, event_id FROM events WHERE event_type = 'view' UNION ALL SELECT 'favourite', event_id FROM events WHERE event_type = 'purchase' AND user_id % 5 <> 0
       UNION ALL SELECT 'having', event_id FROM events WHERE event_type <> 'error' AND user_id % 3 <> 0 UNION ALL SELECT 'lacking', event_id FROM events WHERE event_type = 'error' AND user_id % 3 = 0
       UNION ALL SELECT 'generation', event_id FROM events WHERE user_id % 4 <> 2 UNION ALL SELECT 'prefix', event_id FROM events WHERE event_type NOT LIKE 'pu%'
       UNION ALL SELECT 'feature', event_id FROM events WHERE event_type = 'click' AND user_id = 7 UNION ALL SELECT 'refined', event_id FROM events WHERE event_type = 'view' AND ts::DATE = DATE '2024-01-09' AND user_id % 2 = 1"""
)
def media_filters(spark, sf):
    e, user = table(spark, sf, "events"), F.col("user_id")
    rows = e.select("event_id", "event_type", "ts", user, (F.col("event_type") == "purchase").alias("favourite"), (user % 5 == 0).alias("trashed"), F.when(F.col("event_type") != "error", F.lit(1)).alias("place"), F.when(user % 3 != 0, F.lit(1)).alias("hash"), (user % 4).alias("generation"), F.concat(F.lit("cam"), user % 2).alias("model"))
    features_ = rows.select("event_id", user.cast("string").alias("filePath"), F.col("event_type").alias("pluginId"), F.lit("x").alias("featureType"))
    found = {
        "scene": browse.of_scene(rows, "event_type", "view"),
        "favourite": browse.favourites(rows, "favourite", "trashed"),
        "having": browse.having(rows, "place", "hash"),
        "lacking": browse.lacking(rows, "place", "hash"),
        "generation": browse.other_generation(rows, "generation", 2),
        "prefix": browse.without_prefix(rows, "event_type", "pu"),
        "feature": browse.features_of(features_, path="7", plugin="click", kind="x"),
        "refined": browse.refined(rows, kind="view", day="2024-01-09", camera="CAM1", kind_col="event_type", time_col="ts"),
    }
    out = None
    for name, kept in found.items():
        part = kept.select(F.lit(name).alias("filter"), "event_id")
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 40")
def trash_page(spark, sf):
    rows = table(spark, sf, "orders").withColumn("gone", F.col("o_orderstatus") == "F")
    return browse.trash(rows, "gone", "o_totalprice", "o_orderkey").limit(40).select("o_orderkey", "o_custkey")


@query("SELECT doc_id, n_chars, sha256(text) AS fingerprint FROM documents")
def version_projection(spark, sf):
    rows = table(spark, sf, "documents").withColumn("fingerprint", F.sha2("text", 256))
    return browse.version_rows(rows, "doc_id", "n_chars", "fingerprint")


# --- roll-ups -------------------------------------------------------------------------------


@query(
    """SELECT year(ts) AS "year", month(ts) - 1 AS "month", day(ts) AS "day", count(*) AS n, (epoch_us(max(ts)) // 1000) AS newest_ms,
       CASE grouping(year(ts), month(ts), day(ts)) WHEN 3 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS level
       FROM events GROUP BY ROLLUP (year(ts), month(ts), day(ts)) HAVING grouping(year(ts), month(ts), day(ts)) < 7"""
)
def timeline_rollup(spark, sf):
    return rollup.timeline(table(spark, sf, "events"), "ts").select("year", "month", "day", "n", ms("newest").alias("newest_ms"), "level")


@query(
    """SELECT year(ts) AS "year", strftime(ts, '%Y-%m-%d') AS "day", count(*) AS n, (epoch_us(max(ts)) // 1000) AS newest_ms FROM events GROUP BY 1, 2
       UNION ALL SELECT year(ts), NULL, count(*), (epoch_us(max(ts)) // 1000) FROM events GROUP BY 1"""
)
def timeline_flat(spark, sf):
    return rollup.flat_timeline(table(spark, sf, "events"), "ts").select("year", F.col("day").cast("string").alias("day"), "n", ms("newest").alias("newest_ms"))


@query('SELECT year(o_orderdate) AS "year", count(*) AS n FROM orders GROUP BY 1')
def year_buckets(spark, sf):
    return rollup.year_buckets(table(spark, sf, "orders"), "o_orderdate")


@query('SELECT DISTINCT year(o_orderdate) AS "year" FROM orders')
def available_years(spark, sf):
    return rollup.available_years(table(spark, sf, "orders"), "o_orderdate")


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY event_type")
def scene_histogram(spark, sf):
    return rollup.histogram(table(spark, sf, "events"), "event_type")


@query(
    """SELECT count(*) AS total, count(DISTINCT user_id) AS users, count(*) FILTER (event_type = 'purchase') AS favourites,
       count(*) FILTER (event_type = 'error') AS trashed, (epoch_us(min(ts)) // 1000) AS first_ms, (epoch_us(max(ts)) // 1000) AS last_ms, coalesce(max(event_id), 0) AS generation FROM events"""
)
def stats_bundle(spark, sf):
    kind = F.col("event_type")
    return (
        table(spark, sf, "events")
        .agg(F.count("*").alias("total"), F.count_distinct("user_id").alias("users"), F.count_if(kind == "purchase").alias("favourites"), F.count_if(kind == "error").alias("trashed"), F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.coalesce(F.max("event_id"), F.lit(0)).alias("generation"))
        .select("total", "users", "favourites", "trashed", ms("lo").alias("first_ms"), ms("hi").alias("last_ms"), "generation")
    )


@query(
    """SELECT user_id, count(DISTINCT event_type) AS members, count(*) AS n, arg_min(event_id, (ts, event_id)) AS representative, max(props) AS any_name
       FROM events WHERE user_id IS NOT NULL GROUP BY user_id"""
)
def cluster_summary(spark, sf):
    return rollup.cluster_summary(table(spark, sf, "events"), "user_id", "event_type", "ts", "event_id", "props")


TREE_SQL = r"""SELECT page_id, regexp_replace(split_part(split_part(regexp_replace(url, '^[a-z]+://', '/'), '?', 1), '#', 1), '/[^/]*$', '') AS dir FROM pages"""


def _page_dirs(spark, sf):
    path = F.regexp_replace(F.substring_index(F.substring_index(F.regexp_replace("url", "^[a-z]+://", "/"), "?", 1), "#", 1), "/[^/]*$", "")
    return table(spark, sf, "pages").select("page_id", path.alias("dir"))


@query(
    f"""WITH d AS ({TREE_SQL}), own AS (SELECT dir, count(*) AS c FROM d GROUP BY dir),
    up AS (SELECT dir, c, '/' || array_to_string(list_filter(string_split(dir, '/'), x -> x <> '')[1:i], '/') AS path
           FROM own, unnest(range(1, greatest(len(list_filter(string_split(dir, '/'), x -> x <> '')), 1) + 1)) t(i))
    SELECT path, sum(CASE WHEN dir = path THEN c ELSE 0 END)::BIGINT AS own, sum(c)::BIGINT AS total, count(*) AS leaves, len(string_split(path, '/')) - 1 AS depth FROM up GROUP BY path""".replace("x -> x", "lambda x: x")
)
def tree_rollup(spark, sf):
    return rollup.tree(_page_dirs(spark, sf), "dir")


@query(
    f"""WITH d AS ({TREE_SQL}),
    up AS (SELECT page_id, '/' || array_to_string(list_filter(string_split(dir, '/'), lambda x: x <> '')[1:i], '/') AS path
           FROM d, unnest(range(1, greatest(len(list_filter(string_split(dir, '/'), lambda x: x <> '')), 1) + 1)) t(i))
    SELECT path AS dir, row_number() OVER (PARTITION BY path ORDER BY page_id % 97 DESC, page_id) AS rank, page_id AS cover FROM up QUALIFY rank <= 4"""
)
def tree_covers(spark, sf):
    rows = _page_dirs(spark, sf).withColumn("at", F.col("page_id") % 97)
    return rollup.covers(rows, "dir", "at", "page_id")


@query(
    f"""WITH d AS ({TREE_SQL}), own AS (SELECT dir, count(*) AS c FROM d GROUP BY dir),
    up AS (SELECT dir, c, '/' || array_to_string(list_filter(string_split(dir, '/'), lambda x: x <> '')[1:i], '/') AS path
           FROM own, unnest(range(1, greatest(len(list_filter(string_split(dir, '/'), lambda x: x <> '')), 1) + 1)) t(i))
    SELECT path, sum(CASE WHEN dir = path THEN c ELSE 0 END)::BIGINT AS own FROM up GROUP BY path HAVING sum(CASE WHEN dir = path THEN c ELSE 0 END) > 0"""
)
def tree_flattened(spark, sf):
    return rollup.flattened(rollup.tree(_page_dirs(spark, sf), "dir"), "own", "path").select("path", "own")


@query(
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events),
    s AS (SELECT event_type, list_sort(list(value)) AS v FROM r WHERE r <= 512 GROUP BY event_type)
    SELECT e.event_type, count(*) AS n, count(*) FILTER (value > 90) AS failures, min(value) AS least, max(value) AS largest, round(avg(value), 6) AS mean,
    any_value(v[ceil((len(v) - 1) * 0.5)::INT + 1]) AS p50, any_value(v[ceil((len(v) - 1) * 0.95)::INT + 1]) AS p95 FROM events e JOIN s USING (event_type) GROUP BY e.event_type"""
)
def latency_percentiles(spark, sf):
    return rollup.latency(table(spark, sf, "events"), "event_type", "ts", "event_id", "value", F.col("value") > 90).withColumn("mean", F.round("mean", 6))


# --- joins, differences, duplicates ---------------------------------------------------------


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_features(spark, sf):
    return merge.missing(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")


@query("SELECT doc_id FROM labels WHERE quality <> 1")
def stale_rows(spark, sf):
    return merge.stale(table(spark, sf, "labels"), "quality", 1).select("doc_id")


@query("SELECT doc_id, n_chars FROM documents WHERE n_chars IN (SELECT n_chars FROM documents GROUP BY n_chars HAVING count(*) > 1)")
def repeat_key_candidates(spark, sf):
    return dedup.repeated_values(table(spark, sf, "documents").select("doc_id", "n_chars"), "n_chars")


DUP_SQL = """hashed AS (SELECT doc_id, n_chars, sha256(text) AS exact_hash FROM documents),
    grouped AS (SELECT exact_hash, count(*) AS member_count, sum(n_chars)::BIGINT AS total_bytes, (sum(n_chars) - max(n_chars))::BIGINT AS wasted_bytes, min(doc_id) AS keep_path
                FROM hashed GROUP BY exact_hash HAVING count(*) > 1)"""


def _hashed(spark, sf):
    return dedup.hashed(table(spark, sf, "documents").select("doc_id", "n_chars", "text"), "n_chars", F.col("text").cast("binary")).drop("text")


@query(f"WITH {DUP_SQL} SELECT * FROM grouped")
def dup_groups(spark, sf):
    return dedup.groups(_hashed(spark, sf), "doc_id", "n_chars")


@query(f"WITH {DUP_SQL} SELECT exact_hash, doc_id, doc_id = keep_path AS keep FROM hashed JOIN grouped USING (exact_hash)")
def dup_members(spark, sf):
    rows = _hashed(spark, sf)
    return dedup.members(rows, dedup.groups(rows, "doc_id", "n_chars"), "doc_id")


@query(f"WITH {DUP_SQL} SELECT doc_id FROM hashed JOIN grouped USING (exact_hash) WHERE doc_id <> keep_path")
def dup_delete(spark, sf):
    rows = _hashed(spark, sf)
    return dedup.members(rows, dedup.groups(rows, "doc_id", "n_chars"), "doc_id").filter("not keep").select("doc_id")


@query(
    """SELECT coalesce(c_custkey, s_suppkey) AS "key", coalesce(nullif(trim(c_name), ''), nullif(trim(s_name), '')) AS name, coalesce(c_nationkey, s_nationkey) AS nation,
       coalesce(c_acctbal, s_acctbal) AS balance, (CASE WHEN c_custkey IS NULL THEN 0 ELSE 1 END) | (CASE WHEN s_suppkey IS NULL THEN 0 ELSE 2 END) AS source_mask
       FROM customer FULL OUTER JOIN (SELECT s_suppkey + 1450 AS s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier) s ON c_custkey = s_suppkey"""
)
def source_merge(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    b = table(spark, sf, "supplier").select((F.col("s_suppkey") + 1450).alias("key"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    return merge.merge_sources(a, b, "key", ["name", "nation", "balance"])


@query(
    """SELECT s_suppkey AS "key", s_name AS name, s_acctbal AS balance FROM supplier
       UNION ALL SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)"""
)
def replace_merge(spark, sf):
    old = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    new = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return merge.replace(old, new, "key")


@query(
    """SELECT c_custkey AS "key", c_name AS name FROM customer
       UNION ALL SELECT s_suppkey + 1450, s_name FROM supplier WHERE s_suppkey + 1450 NOT IN (SELECT c_custkey FROM customer)"""
)
def ignore_merge(spark, sf):
    old = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    new = table(spark, sf, "supplier").select((F.col("s_suppkey") + 1450).alias("key"), F.col("s_name").alias("name"))
    return merge.ignore(old, new, "key")


@query("SELECT DISTINCT o_custkey AS \"key\" FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def path_intersection(spark, sf):
    wanted = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("key"))
    return merge.common_keys(table(spark, sf, "orders").select(F.col("o_custkey").alias("key")), wanted, "key")


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus FROM orders GROUP BY o_custkey")
def latest_per_directory(spark, sf):
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus")
    return merge.latest_per_group(rows, "o_custkey", "o_orderdate", "o_orderkey").drop("o_orderdate")


@query(
    """SELECT e.event_id, p.value AS last_purchase FROM (SELECT * FROM events WHERE event_type = 'view') e
       ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts) p ON e.user_id = p.user_id AND e.ts >= p.ts"""
)
def as_of_purchase(spark, sf):
    e = table(spark, sf, "events")
    bought = e.filter("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    views = e.filter("event_type = 'view'").select("event_id", "user_id", "ts")
    return merge.as_of(views, bought, "user_id", "ts", "value", "last_purchase").select("event_id", "last_purchase")


# --- text -----------------------------------------------------------------------------------

TOKENS_SQL = r"SELECT DISTINCT doc_id, lang, n_chars, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS token FROM documents"


_STORED: dict[tuple[str, str], str] = {}


def _index(spark, sf):
    """The index of the documents' texts, which the first search of an application writes."""
    made, at = text_search.index(table(spark, sf, "documents"), "doc_id", "text"), (spark.sparkContext.applicationId, sf)
    if at not in _STORED:
        path = scratch.temporary(spark, "index")
        text_search.stored(made, path)
        _STORED[at] = path
    return spark.read.schema(made.schema).parquet(_STORED[at])


@query(f"SELECT DISTINCT doc_id FROM ({TOKENS_SQL}) WHERE token LIKE 'token%' OR token LIKE 'thnd%'")
def fts_prefix_or(spark, sf):
    return text_search.prefix_or(_index(spark, sf), "doc_id", "Token  thnd")


@query(f"SELECT doc_id FROM ({TOKENS_SQL}) WHERE token IN ('the', 'this') GROUP BY doc_id HAVING count(DISTINCT token) = 2")
def fts_token_and(spark, sf):
    return text_search.token_and(_index(spark, sf), "doc_id", "the this")


@query(f"SELECT count(DISTINCT doc_id) AS n FROM ({TOKENS_SQL}) WHERE token LIKE 'copyright%' OR token LIKE 'license%'")
def fts_count(spark, sf):
    return text_search.prefix_or(_index(spark, sf), "doc_id", "copyright license").agg(F.count("*").alias("n"))


@query(f"SELECT DISTINCT doc_id, lang FROM ({TOKENS_SQL}) WHERE token LIKE 'un%' AND lang = 'fr' AND n_chars <= 3000")
def fts_filtered(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return text_search.search(docs, text_search.prefix_or(_index(spark, sf), "doc_id", "un"), "doc_id", F.col("lang") == "fr", F.col("n_chars") <= 3000).select("doc_id", "lang")


@query(f"SELECT token, count(*) AS documents FROM ({TOKENS_SQL}) WHERE token <> '' GROUP BY token")
def document_frequency(spark, sf):
    return text_search.document_frequency(_index(spark, sf))


# --- vectors --------------------------------------------------------------------------------

DOT = "list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE))"
ONE_HOT = [1.0 if i % 7 == 0 else 0.25 for i in range(64)]
ONE_HOT_SQL = "[" + ", ".join(f"{x}::FLOAT" for x in ONE_HOT) + "]"


def cosine_sql(a: str, b: str) -> str:
    return f"({DOT.format(a=a, b=b)} / (sqrt({DOT.format(a=a, b=a)}) * sqrt({DOT.format(a=b, b=b)})))"


SIMILAR_SQL = f"SELECT vec_id, round({cosine_sql('embedding', 'q')}, 4) AS similarity FROM embeddings, (SELECT {ONE_HOT_SQL} AS q)"


@query(f"SELECT * FROM ({SIMILAR_SQL}) WHERE similarity >= 0.0 ORDER BY similarity DESC, vec_id LIMIT 50")
def vector_topk(spark, sf):
    return vector.top_k(table(spark, sf, "embeddings"), "vec_id", "embedding", vector.literal(ONE_HOT), 50, 0.0, digits=4).select("vec_id", "similarity")


@query(f"SELECT * FROM ({SIMILAR_SQL}) WHERE similarity >= 0.1")
def vector_threshold(spark, sf):
    rows = vector.scored(table(spark, sf, "embeddings"), "embedding", vector.literal(ONE_HOT)).withColumn("similarity", F.round("similarity", 4))
    return rows.filter("similarity >= 0.1").select("vec_id", "similarity")


@query(
    f"""SELECT e.vec_id, round({cosine_sql("e.embedding", "q.embedding")}, 4) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q
        WHERE e.vec_id <> 7 ORDER BY similarity DESC, e.vec_id LIMIT 20"""
)
def vector_similar(spark, sf):
    rows = table(spark, sf, "embeddings")
    own = rows.filter("vec_id = 7").select("embedding").first()  # one row by its key
    return vector.top_k(rows, "vec_id", "embedding", vector.literal(own["embedding"]), 20, -1.0, exclude=7, digits=4).select("vec_id", "similarity")


@query(
    f"""WITH s AS (SELECT * FROM ({SIMILAR_SQL}) WHERE similarity >= 0.1 AND vec_id <> 3)
        SELECT (SELECT count(*) FROM embeddings) AS scanned, (SELECT count(*) FROM embeddings WHERE vec_id % 10 = 0) AS invalid, least(count(*) FILTER (vec_id % 10 <> 0), 50) AS hits,
        max(similarity) FILTER (vec_id % 10 <> 0) AS best, true AS encoded FROM s"""
)
def search_account(spark, sf):
    rows = table(spark, sf, "embeddings").withColumn("embedding", F.when(F.col("vec_id") % 20 == 0, F.slice("embedding", 1, 63)).when(F.col("vec_id") % 10 != 0, F.col("embedding")))
    return vector.search_detailed(rows, "vec_id", "embedding", ONE_HOT, 50, 0.1, exclude=3)[1].withColumn("best", F.round("best", 4))


@query("SELECT count(*) AS vectors, max(len(embedding)) AS dimension FROM embeddings WHERE label = 3")
def search_stats(spark, sf):
    rows = table(spark, sf, "embeddings").withColumn("space", F.concat(F.lit("s"), "label"))
    return vector.space_stats(rows, "space", "s3", "embedding")


CENTROIDS_SQL = """cells AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, unnest(range(1, 65)) t(i) GROUP BY label, i),
    centroids AS (SELECT label, list(m ORDER BY i) AS centroid FROM cells GROUP BY label)"""


@query(f"WITH {CENTROIDS_SQL} SELECT label, list_transform(centroid, lambda x: round(x, 6)) AS centroid FROM centroids")
def label_centroids(spark, sf):
    return rollup.centroids(table(spark, sf, "embeddings"), "label", "embedding").withColumn("centroid", F.transform("centroid", lambda x: F.round(x, 6)))


@query(
    f"""WITH {CENTROIDS_SQL} SELECT vec_id, arg_min(c.label, (d, c.label)) AS prototype, round(min(d), 4) AS distance FROM
        (SELECT e.vec_id, c.label, 1 - {cosine_sql("e.embedding", "c.centroid")} AS d FROM embeddings e, centroids c) c GROUP BY vec_id"""
)
def nearest_prototype(spark, sf):
    rows = table(spark, sf, "embeddings")
    means = rollup.centroids(rows, "label", "embedding").withColumnRenamed("label", "p")
    return vector.nearest_prototype(rows.select("vec_id", "embedding"), "embedding", means, "p", "centroid").select("vec_id", "prototype", F.round("distance", 4).alias("distance"))


@query(
    f"""SELECT a.vec_id AS a, b.vec_id AS b, round(1 - {cosine_sql("a.embedding", "b.embedding")}, 4) AS distance FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
        WHERE 1 - {cosine_sql("a.embedding", "b.embedding")} <= 0.6"""
)
def eps_pairs(spark, sf):
    return vector.near_pairs(table(spark, sf, "embeddings"), "vec_id", "embedding", 0.6).withColumn("distance", F.round("distance", 4))


@query(
    """WITH b AS (SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS bucket FROM embeddings),
    c AS (SELECT bucket, count(*) AS members FROM b GROUP BY bucket ORDER BY bucket LIMIT 8) SELECT vec_id, bucket, members FROM b JOIN c USING (bucket) WHERE members >= 5"""
)
def argmax_buckets(spark, sf):
    return vector.argmax_buckets(table(spark, sf, "embeddings"), "vec_id", "embedding")


SAMPLE_SQL = """list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(regexp_extract_all(hex(encode({0}::VARCHAR)), '..'), lambda h: ('0x' || h)::HUGEINT)),
    lambda a, v: (xor(a, v) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)"""
GENERATION_SQL = f"""picked AS (SELECT *, list_position(embedding, list_max(embedding)) - 1 AS bucket FROM embeddings ORDER BY {SAMPLE_SQL.format("vec_id")}, vec_id LIMIT 300),
    counted AS (SELECT bucket, count(*) AS members, row_number() OVER (ORDER BY bucket) - 1 AS number FROM picked GROUP BY bucket),
    named AS (SELECT bucket, members, 'cluster-' || number || '-' || bucket AS cluster, members / (SELECT count(*) FROM picked) AS score FROM counted WHERE number < 8 AND members >= 5)"""


@query(
    f"""WITH {GENERATION_SQL}, cells AS (SELECT cluster, i, avg(embedding[i]::DOUBLE) AS m FROM picked JOIN named USING (bucket), unnest(range(1, 65)) t(i) GROUP BY cluster, i)
    SELECT cluster, bucket, members, score, c.centroid FROM named JOIN (SELECT cluster, list(round(m, 6) ORDER BY i) AS centroid FROM cells GROUP BY cluster) c USING (cluster)"""
)
def cluster_generation(spark, sf):
    found, _ = cluster.generation(table(spark, sf, "embeddings"), "vec_id", "embedding", size=300)
    return found.withColumn("centroid", F.transform("centroid", lambda x: F.round(x, 6)))


@query(f"WITH {GENERATION_SQL} SELECT cluster, row_number() OVER (PARTITION BY cluster ORDER BY vec_id) - 1 AS rank, vec_id FROM picked JOIN named USING (bucket) QUALIFY rank < 20")
def cluster_generation_members(spark, sf):
    return cluster.generation(table(spark, sf, "embeddings"), "vec_id", "embedding", size=300)[1]


@query(
    f"""WITH RECURSIVE pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE 1 - {cosine_sql("a.embedding", "b.embedding")} <= 0.6),
    core AS (SELECT a AS k FROM pairs GROUP BY a HAVING count(*) + 1 >= 3),
    links AS (SELECT a, b FROM pairs WHERE a IN (FROM core) AND b IN (FROM core)),
    reach AS (SELECT k AS x, k AS y FROM core UNION SELECT r.x, l.b FROM reach r JOIN links l ON l.a = r.y),
    rooted AS (SELECT x AS k, min(y) AS root FROM reach GROUP BY x)
    SELECT e.vec_id, coalesce(r.root, (SELECT min(q.root) FROM pairs p JOIN rooted q ON q.k = p.b WHERE p.a = e.vec_id)) AS cluster, r.root IS NOT NULL AS core FROM embeddings e LEFT JOIN rooted r ON r.k = e.vec_id"""
)
def dbscan_clusters(spark, sf):
    return cluster.dbscan(table(spark, sf, "embeddings"), "vec_id", "embedding", eps=0.6, min_points=3)


@query()
def cluster_prototypes(spark, sf):
    return cluster.prototypes(table(spark, sf, "embeddings"), "label", "vec_id", "embedding").withColumn("embedding", vectors.to_csv(F.col("embedding")))


@query()
def incremental_assignment(spark, sf):
    rows = table(spark, sf, "embeddings")
    known = rollup.centroids(rows.filter("label < 5"), "label", "embedding").select(F.concat(F.lit("known:"), "label").alias("name"), "centroid")
    return cluster.assign(rows.select("vec_id", "embedding"), known, "vec_id", "embedding", "name", "centroid", most=0.7, eps=0.6)


@query()
def semantic_clusters(spark, sf):
    return cluster.semantic_clusters(table(spark, sf, "embeddings"), "vec_id", "embedding").withColumn("distance", F.round("distance", 4))


@query("SELECT vec_id, embedding FROM embeddings")
def vector_codecs(spark, sf):
    rows = table(spark, sf, "embeddings")
    return rows.select("vec_id", vectors.decode_blob(vectors.encode_blob(F.col("embedding"))).alias("embedding"))


@query("SELECT count(*) AS vectors, 'READY' AS state FROM embeddings WHERE label = 3")
def vector_space_state(spark, sf):
    rows = table(spark, sf, "embeddings").withColumn("space", F.concat(F.lit("s"), "label"))
    return vector.space_state(rows, "space", "s3")


# --- groups in order ------------------------------------------------------------------------


@query("SELECT l_orderkey, arg_max(l_linenumber, (l_extendedprice, -l_linenumber)) AS l_linenumber FROM lineitem GROUP BY l_orderkey")
def largest_per_group(spark, sf):
    box = F.struct(F.lit(0.0).alias("left"), F.lit(0.0).alias("top"), F.col("l_extendedprice").alias("right"), F.lit(1.0).alias("bottom"))
    faces = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", box.alias("box"))
    return cluster.largest_per_photo(faces, "l_orderkey", "l_linenumber", "box").select("l_orderkey", "l_linenumber")


@query("SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_size DESC, p_partkey) AS rank FROM part QUALIFY rank <= 20 AND count(*) OVER (PARTITION BY p_brand) >= 5")
def topn_per_group(spark, sf):
    order = [F.col("p_retailprice").desc(), F.col("p_size").desc(), F.col("p_partkey").asc()]
    return recommend.top_per_group(table(spark, sf, "part"), "p_brand", order, 20, 5).select("p_brand", "p_partkey", "rank")


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS rank FROM conversations QUALIFY rank <= 20")
def conversation_rank(spark, sf):
    return recommend.top_per_group(table(spark, sf, "conversations"), "conv_id", [F.length("text").desc(), F.col("turn").asc()], 20).select("conv_id", "turn", "rank")


SESSION_SQL = """marked AS (SELECT *, CASE WHEN floor((epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 3600000000) > 6 OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new
                FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    numbered AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session FROM marked)"""


@query(
    f"""WITH {SESSION_SQL} SELECT user_id, session, count(*) AS n, (epoch_us(min(ts)) // 1000) AS first_ms, (epoch_us(max(ts)) // 1000) AS last_ms,
        floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 3600000000)::BIGINT AS span_hours FROM numbered GROUP BY user_id, session HAVING count(*) >= 3"""
)
def event_sessions(spark, sf):
    out = sessions.events(table(spark, sf, "events"), "user_id", "ts", "event_id")
    return out.select("user_id", "session", "n", ms("first_at").alias("first_ms"), ms("last_at").alias("last_ms"), "span_hours")


def score_sql(density: str, days: str, quality: str, weekends: str, favourites: str, w: tuple[float, float, float, float, float]) -> str:
    dens = f"greatest(0.0, least(1.0, ln(1 + {density}) / ln(11.0)))"
    age = f"(1 - exp(-greatest({days}, 0) / 30.0))"
    return f"round({w[0]} * {dens} + {w[1]} * {age} + {w[2]} * {quality} + {w[3]} * {weekends} + {w[4]} * {favourites}, 6)"


@query(
    f"""WITH m AS (SELECT o_custkey, count(*) AS n, min(o_orderdate) AS lo, max(o_orderdate) AS hi, avg(o_totalprice / 500000.0) AS quality,
        avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS favourites, avg(CASE WHEN dayofweek(o_orderdate) IN (0, 6) THEN 1.0 ELSE 0.0 END) AS weekends FROM orders GROUP BY o_custkey),
    s AS (SELECT *, greatest(1, floor((epoch_us(hi) - epoch_us(lo)) / 86400000000)) AS span FROM m)
    SELECT o_custkey, n, span::BIGINT AS span_days, n >= 500 AND span >= 60 AS is_large,
    {score_sql("(CASE WHEN n = 1 THEN 1.0 ELSE n / span END)", f"floor((epoch_us({ORDERS_NOW_SQL}) - epoch_us(hi)) / 86400000000)", "quality", "weekends", "favourites", (0.3, 0.3, 0.2, 0.1, 0.1))} AS score FROM s"""
)
def album_scores(spark, sf):
    out = recommend.albums(table(spark, sf, "orders"), "o_custkey", "o_orderdate", F.col("o_totalprice") / 500000.0, F.col("o_orderstatus") == "F", F.lit("2002-01-01 00:00:00").cast("timestamp_ntz"))
    return out.select("o_custkey", "n", "span_days", "is_large", F.round("score", 6).alias("score"))


@query(
    f"""WITH top AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_size DESC, p_partkey) AS r FROM part QUALIFY r <= 20),
    m AS (SELECT p_type, count(*) AS n, avg(p_retailprice) AS quality, avg(CASE WHEN p_brand = 'Brand#2' THEN 1.0 ELSE 0.0 END) AS favourites, max(p_size) AS days FROM top GROUP BY p_type HAVING count(*) >= 5)
    SELECT p_type, n, round(0.4 * (quality / 2000.0) + 0.3 * (1 - exp(-(100 - days) / 30.0)) + 0.2 * (1 - exp(-n / 10.0)) + 0.1 * favourites, 6) AS score FROM m"""
)
def scene_scores(spark, sf):
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size")).cast("timestamp_ntz")
    rows = table(spark, sf, "part").withColumn("at", day).withColumn("q", F.col("p_retailprice") / 2000.0)
    out = recommend.scenes(rows, "p_type", "at", "p_partkey", "q", F.col("p_brand") == "Brand#2", F.date_add(F.lit("2024-01-01").cast("date"), 100).cast("timestamp_ntz"))
    return out.select("p_type", "n", F.round("score", 6).alias("score"))


@query(
    f"""WITH {SESSION_SQL}, m AS (SELECT user_id, session, count(*) AS n, min(ts) AS lo, max(ts) AS hi, avg(value / 100.0) AS quality,
        avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END) AS favourites, avg(CASE WHEN dayofweek(ts) IN (0, 6) THEN 1.0 ELSE 0.0 END) AS weekends
        FROM numbered GROUP BY user_id, session HAVING count(*) >= 3),
    d AS (SELECT *, n / greatest(1, floor((epoch_us(hi) - epoch_us(lo)) / 3600000000)) AS density FROM m)
    SELECT user_id, session, n, round(0.2 * greatest(0.0, least(1.0, ln(1 + density) / ln(11.0))) + 0.25 * (1 - exp(-greatest(floor((epoch_us(TIMESTAMP '2024-03-01') - epoch_us(hi)) / 86400000000), 0) / 30.0))
        + 0.25 * quality + 0.1 * weekends + 0.1 * (1 - exp(-n / 10.0)) + 0.1 * favourites, 6) AS score FROM d"""
)
def event_scores(spark, sf):
    now = F.lit("2024-03-01 00:00:00").cast("timestamp_ntz")
    out = recommend.events(table(spark, sf, "events"), "user_id", "ts", "event_id", F.col("value") / 100.0, F.col("event_type") == "purchase", now)
    return out.select("user_id", "session", "n", F.round("score", 6).alias("score"))


BUSY_SQL = """days AS (SELECT event_type, ts::DATE AS day, count(*) AS c, min(ts) AS lo, max(ts) AS hi FROM events GROUP BY 1, 2),
    spans AS (SELECT *, sum(c) OVER (PARTITION BY event_type) / greatest(1, floor((epoch_us(max(hi) OVER (PARTITION BY event_type)) - epoch_us(min(lo) OVER (PARTITION BY event_type))) / 86400000000)) AS mean FROM days),
    runs AS (SELECT a.event_type, a.day AS first_day, s.size, any_value(a.mean) AS mean, max(b.day) AS last_day, sum(b.c)::BIGINT AS n, count(*) AS active
        FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) AS r FROM spans) a
        JOIN (VALUES (7), (14), (21), (30)) s(size) ON true
        JOIN (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) AS r FROM spans) b ON a.event_type = b.event_type AND b.r >= a.r AND b.r < a.r + s.size
        GROUP BY 1, 2, 3 HAVING count(*) = s.size)"""


@query(f"WITH {BUSY_SQL} SELECT event_type, size, first_day::VARCHAR AS first_day, last_day::VARCHAR AS last_day, n, n / size AS density FROM runs WHERE n / size >= mean * 1.02")
def busy_windows(spark, sf):
    out = sessions.busy_windows(table(spark, sf, "events"), "event_type", "ts", factor=1.02)
    return out.select("event_type", "size", F.col("first_day").cast("string").alias("first_day"), F.col("last_day").cast("string").alias("last_day"), "n", "density")


@query()
def window_recommendations(spark, sf):
    now = F.lit("2024-03-01 00:00:00").cast("timestamp_ntz")
    rows = table(spark, sf, "events").filter("event_id % 7 < 2 or day(ts) between 8 and 15")  # a busy week for each kind
    found = recommend.windows(rows, "event_type", "ts", F.col("value") / 100.0, F.col("user_id") % 2 == 0, now)
    return found.select("event_type", "size", F.col("first_day").cast("string").alias("first_day"), F.col("last_day").cast("string").alias("last_day"), "n", "pick", F.round("score", 6).alias("score"))


GLOBAL_SESSION_SQL = """kept AS (SELECT * FROM events WHERE event_type = 'purchase' AND user_id % 7 = 0),
    marked AS (SELECT *, CASE WHEN floor((epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 3600000000) > 6 OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new
        FROM kept WINDOW w AS (ORDER BY ts, event_id)),
    numbered AS (SELECT *, sum(new) OVER (ORDER BY ts, event_id)::BIGINT AS session FROM marked)"""


@query(f"WITH {GLOBAL_SESSION_SQL} SELECT session, count(*) AS n, (epoch_us(min(ts)) // 1000) AS first_ms, (epoch_us(max(ts)) // 1000) AS last_ms FROM numbered GROUP BY session HAVING count(*) >= 3")
def library_events(spark, sf):
    rows = table(spark, sf, "events").filter("event_type = 'purchase' and user_id % 7 = 0")
    return sessions.events(rows, None, "ts", "event_id").select("session", "n", ms("first_at").alias("first_ms"), ms("last_at").alias("last_ms"))


@query(
    """WITH top AS (SELECT vec_id, label, CAST(vec_id % 13 AS DOUBLE) / 13 AS q, vec_id % 29 AS d, vec_id % 4 = 0 AS f, row_number() OVER (PARTITION BY label ORDER BY vec_id % 13 DESC, vec_id % 29 DESC, vec_id) AS r FROM embeddings QUALIFY r <= 20),
    m AS (SELECT label, count(*) AS n, max(d) AS last, avg(q) AS quality, avg(CASE WHEN f THEN 1.0 ELSE 0.0 END) AS favourites FROM top GROUP BY label HAVING count(*) >= 5),
    c AS (SELECT label, greatest(0.0, least(1.0, 1 - avg(CAST(vec_id % 17 AS DOUBLE) / 10) / 2)) AS cohesion FROM embeddings GROUP BY label)
    SELECT label, n, round(cohesion, 6) AS cohesion, round(0.3 * quality + 0.3 * (1 - exp(-(100 - last) / 30.0)) + 0.2 * (1 - exp(-n / 10.0)) + 0.2 * cohesion, 6) AS score FROM m JOIN c USING (label)"""
)
def cluster_scores(spark, sf):
    key, start = F.col("vec_id"), F.lit("2024-01-01").cast("date")
    rows = table(spark, sf, "embeddings").select(key, "label", (key % 13 / 13.0).alias("quality"), F.date_add(start, (key % 29).cast("int")).cast("timestamp_ntz").alias("at"), (key % 4 == 0).alias("liked"), (key % 17 / 10.0).alias("distance"))
    out = recommend.clusters(rows, "label", "distance", "at", "vec_id", "quality", F.col("liked"), F.date_add(start, 100).cast("timestamp_ntz"))
    return out.select("label", "n", F.round("cohesion", 6).alias("cohesion"), F.round("score", 6).alias("score"))


ALBUM_SQL = f"""SELECT '{{0}}' AS category, user_id::VARCHAR AS id, count(*) AS n, avg(value / 100.0) AS quality, avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END) AS favourites,
    avg(CASE WHEN dayofweek(ts) IN (0, 6) THEN 1.0 ELSE 0.0 END) AS weekends, greatest(1, floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000)) AS span, max(ts) AS hi FROM events GROUP BY user_id"""


@query(
    f"""WITH a AS ({ALBUM_SQL.format("WHOLE_ALBUM")}),
    albums AS (SELECT category, id, n, quality, {score_sql("(CASE WHEN n = 1 THEN 1.0 ELSE n / span END)", "floor((epoch_us(TIMESTAMP '2024-03-01') - epoch_us(hi)) / 86400000000)", "quality", "weekends", "favourites", (0.3, 0.3, 0.2, 0.1, 0.1))} AS score FROM a),
    top AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, ts DESC, event_id) AS r FROM events WHERE event_type IS NOT NULL QUALIFY r <= 20),
    m AS (SELECT event_type, count(*) AS n, avg(value / 100.0) AS quality, max(ts) AS hi, avg(CASE WHEN user_id % 2 = 0 THEN 1.0 ELSE 0.0 END) AS favourites FROM top GROUP BY event_type HAVING count(*) >= 5),
    scenes AS (SELECT 'SCENE_THEME' AS category, event_type AS id, n, quality, round(0.4 * quality + 0.3 * (1 - exp(-greatest(floor((epoch_us(TIMESTAMP '2024-03-01') - epoch_us(hi)) / 86400000000), 0) / 30.0)) + 0.2 * (1 - exp(-n / 10.0)) + 0.1 * favourites, 6) AS score FROM m)
    SELECT category, id, n, round(score + 0.35 * quality, 5) AS rank_score FROM (FROM albums UNION ALL FROM scenes)"""
)
def all_recommendations(spark, sf):
    now, rows = F.lit("2024-03-01 00:00:00").cast("timestamp_ntz"), table(spark, sf, "events").withColumn("quality_", F.col("value") / 100.0)
    whole = recommend.albums(rows, "user_id", "ts", F.col("quality_"), F.col("event_type") == "purchase", now)
    themes = recommend.scenes(rows, "event_type", "ts", "event_id", "quality_", F.col("user_id") % 2 == 0, now)
    whole, themes = (x.withColumn("score", maths.rounded(F.col("score"), 6)) for x in (whole, themes))  # the bonus is added to the rounded score
    out = recommend.ranked({"WHOLE_ALBUM": (whole, F.col("user_id")), "SCENE_THEME": (themes, F.col("event_type"))}, recommend.QUALITY)
    return out.select("category", "id", "n", maths.rounded(F.col("rank_score"), 5).alias("rank_score"))


@query(
    """WITH r AS (SELECT *, sum(n_chars) OVER (PARTITION BY source ORDER BY lang, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, sum(n_chars) OVER (PARTITION BY source) AS total FROM documents)
    SELECT doc_id, source FROM r WHERE total - coalesce(before, 0) > 50000"""
)
def lru_eviction(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars")
    return sessions.evicted(rows, "lang", "n_chars", ["doc_id"], budget=50_000, protected=F.lit(False), group="source").select("doc_id", "source")


@query(
    """WITH r AS (SELECT event_id, ts, sum(event_id % 100) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events WHERE event_type <> 'error')
    SELECT event_id FROM r WHERE (SELECT sum(event_id % 100) FROM events) - coalesce(before, 0) > 100000"""
)
def lru_eviction_global(spark, sf):
    rows = table(spark, sf, "events").withColumn("bytes", F.col("event_id") % 100)
    return sessions.evicted(rows, "ts", "bytes", ["event_id"], budget=100_000, protected=F.col("event_type") == "error").select("event_id")


@query("SELECT l_partkey AS item, min(l_orderkey) AS rank FROM lineitem GROUP BY l_partkey")
def rotation_claims(spark, sf):
    shown = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("item"), F.col("l_orderkey").alias("rank"))
    return sessions.first_claims(shown, "item", "rank")


@query(
    """SELECT p_partkey, p_brand, ((row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) - 1) // 20)::BIGINT AS chunk FROM part
       WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1992-03-15')"""
)
def rotation_chunks(spark, sf):
    claimed = table(spark, sf, "lineitem").filter("l_shipdate < TIMESTAMP_NTZ '1992-03-15 00:00:00'").select(F.col("l_partkey").alias("p_partkey")).distinct()
    rows = sessions.leftovers(table(spark, sf, "part"), claimed, "p_partkey", ["p_size", "p_partkey"], group="p_brand")
    return rows.select("p_partkey", "p_brand", "chunk")


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 30")
def batch_cursor(spark, sf):
    return sessions.batch(table(spark, sf, "orders"), [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()], 3).select("o_orderkey")


@query()
def diversified_ranking(spark, sf):
    rows = table(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus", "o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("score"), F.min("o_orderkey").alias("id"))
    rows = rows.select((F.col("o_custkey") % 50).alias("list"), F.col("o_orderpriority").alias("category"), F.col("o_orderstatus").alias("album"), "score", "id")
    return sessions.diversify(rows, "list", "list long, category string, album string, score double, id long")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderpriority DESC, o_orderdate, o_orderkey LIMIT 100")
def task_claim(spark, sf):
    queue = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("taskId"), F.col("o_orderpriority").alias("priority"), ms("o_orderdate").alias("createdAt"), F.when(F.col("o_orderstatus") == "O", tasks.PENDING).otherwise(tasks.DONE).alias("status"), F.lit(0).alias("nextRetryAt")
    )
    return tasks.claimable(queue, 0, 100).select(F.col("taskId").alias("o_orderkey"))


# --- functions ------------------------------------------------------------------------------


@query(
    """SELECT p_partkey, sha256(p_name) AS path_key, substr(sha256(p_name), 1, 16) AS short_key,
       'sem:' || sha256(p_brand || chr(31) || p_type || chr(31) || '1' || chr(31) || p_size::VARCHAR || chr(31) || 'f32' || chr(31) || 'le') AS space,
       substr(md5(p_name), 1, 8) || '-' || substr(md5(p_name), 9, 4) || '-3' || substr(md5(p_name), 14, 3) || '-' || substr('89ab89ab89ab89ab', ('0x' || substr(md5(p_name), 17, 1))::INT + 1, 1)
       || substr(md5(p_name), 18, 3) || '-' || substr(md5(p_name), 21, 12) AS uuid FROM part"""
)
def identity_hashes(spark, sf):
    name = F.col("p_name")
    space = hashes.space_id(F.col("p_brand"), F.col("p_type"), F.lit(1), F.col("p_size"), F.lit("f32"), F.lit("le"))
    return table(spark, sf, "part").select("p_partkey", hashes.path_key(name).alias("path_key"), hashes.short_path_hash(name).alias("short_key"), space.alias("space"), hashes.name_uuid(name).alias("uuid"))


@query(f"SELECT doc_id FROM documents ORDER BY {SAMPLE_SQL.format('doc_id')}, doc_id LIMIT 256")
def bottom_k_sample(spark, sf):
    return cluster.sample(table(spark, sf, "documents").select("doc_id"), "doc_id", 256)


@query(
    """SELECT n_nationkey, round(6371.0 * 2 * atan2(sqrt(h), sqrt(1 - h)), 6) AS km FROM (SELECT n_nationkey,
       power(sin(radians(n_nationkey * 2.0 - 10.0) / 2), 2) + cos(radians(10.0)) * cos(radians(n_nationkey * 2.0)) * power(sin(radians(n_nationkey * 5.0 - 20.0) / 2), 2) AS h FROM nation)"""
)
def haversine(spark, sf):
    n = F.col("n_nationkey")
    return table(spark, sf, "nation").select("n_nationkey", F.round(maths.haversine_km(F.lit(10.0), F.lit(20.0), n * 2.0, n * 5.0), 6).alias("km"))


@query(
    """SELECT o_orderkey, CASE datediff('day', o_orderdate::DATE, DATE '2001-08-01') WHEN 0 THEN '今天' WHEN 1 THEN '昨天' ELSE month(o_orderdate) || '月' || day(o_orderdate) || '日 '
       || ['星期日', '星期一', '星期二', '星期三', '星期四', '星期五', '星期六'][dayofweek(o_orderdate) + 1] END AS label, dayofweek(o_orderdate) IN (0, 6) AS weekend FROM orders"""
)
def day_labels(spark, sf):
    day = F.to_date("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", dates.day_label(day, F.lit("2001-08-01").cast("date")).alias("label"), dates.is_weekend(F.col("o_orderdate")).alias("weekend"))


@query(
    """SELECT event_id, (epoch_us(date_trunc('second', ts)) // 1000) AS exif_ms, CAST((epoch_us(ts) // 1000) AS VARCHAR) || ':' || CAST(user_id AS VARCHAR) AS version FROM events"""
)
def captured_times(spark, sf):
    text = F.date_format("ts", "yyyy:MM:dd HH:mm:ss")
    return table(spark, sf, "events").select("event_id", F.unix_millis(dates.exif_instant(text)).alias("exif_ms"), strings.source_version(ms("ts"), F.col("user_id")).alias("version"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def feature_json(spark, sf):
    told = F.to_json(F.struct(F.array(F.col("value").cast("float")).alias("vector"), F.from_json("props", "map<string, string>").alias("metadata")))
    rows = table(spark, sf, "events").select("event_id", codecs.decode_feature(told).alias("feature"))
    return rows.select("event_id", F.col("feature.metadata")["k"].cast("long").alias("k"))


@query("SELECT event_id, event_type AS fileName, (epoch_us(ts) // 1000) AS capturedAtMs, user_id AS fileSize FROM events")
def scan_codec(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.col("event_type").alias("fileName"), ms("ts").alias("capturedAtMs"), F.col("user_id").alias("fileSize"))
    back = codecs.decode_scan(codecs.encode_scan(["fileName", "capturedAtMs", "fileSize"]))
    return rows.select("event_id", back.alias("r")).select("event_id", "r.fileName", "r.capturedAtMs", "r.fileSize")


@query()
def concept_vectors(spark, sf):
    names = table(spark, sf, "part").select("p_partkey", "p_name")
    return names.select("p_partkey", vectors.to_csv(features.embed_text(F.col("p_name"))).alias("concepts"))


@query()
def image_scenes(spark, sf):
    rows = table(spark, sf, "events")
    unit = lambda i: F.pmod(F.xxhash64("event_id", F.lit(i)), F.lit(1000)) / 1000.0
    f = {k: unit(i) for i, k in enumerate(("brightness", "saturation", "red", "green", "blue", "center_brightness", "edge_brightness", "center_saturation", "contrast"))}
    f |= {"blue_green": unit(20) * 1.5, "aspect": unit(21) * 2 + 0.3, "squarish": unit(22) < 0.4, "uniform": unit(23) < 0.3, "width": F.lit(1080), "height": F.lit(1920), "scene": F.lit(None).cast("string"), "ocr": F.col("event_type"), "quality": unit(24)}
    scores = features.scene_scores(f)
    return rows.select("event_id", features.best_label(scores).alias("scene"), F.round(F.greatest(*scores.values()), 6).alias("score"), vectors.argmax(features.image_concepts(f)).alias("concept"))


# --- streams --------------------------------------------------------------------------------


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_live_counts(spark, sf):
    root = scratch.temporary(spark, "live")
    store, schema = Store(spark, root), table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    live.counts_into(stream.select("event_type"), "event_type", store, "counts", f"{root}/checkpoint").awaitTermination()
    return store.read("counts")
