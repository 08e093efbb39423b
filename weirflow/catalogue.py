"""Registered queries over the driver's tables, each with the SQL it must equal."""

from __future__ import annotations

import gzip
import json
from collections.abc import Callable, Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weirflow.functions import dates, http, text, values
from weirflow.operators import chunking, filters, joins, loading, merging, paths, records, schemas, state, state_formats, validation
from weirflow.plans import delegating, incremental, rates, slices
from weirflow.sources import avro, decoders, excel, files, index, json_items, scratch, transfer
from weirflow.streaming import partitions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *tables: str):
    """Registers a function of the named tables' DataFrames."""

    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables))
        if sql:
            SQL[name] = sql
        return f

    return register


def key(events: DataFrame) -> Column:
    return F.get_json_object(events["props"], "$.k").cast("bigint")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["flagship_incremental"](spark, sf_dir)


@query(
    "flagship_incremental",
    """SELECT user_id, count(*) AS n, max(ts) AS next_cursor, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS max_k, round(sum(value * 2), 4) AS doubled
    FROM events WHERE event_type = 'purchase' AND value > 0 AND ts >= TIMESTAMP '1990-01-01' GROUP BY user_id""",
    "events",
)
def _(events):
    kept = filters.keep_where(events, "event_type = 'purchase' and value > 0").where("ts >= '1990-01-01'")
    made = records.add_fields(kept, [("k", key(events), None), ("doubled", "value * 2", "double")])
    return made.groupBy("user_id").agg(
        F.count("*").alias("n"), F.max("ts").cast("timestamp").alias("next_cursor"), F.max("k").alias("max_k"), F.round(F.sum("doubled"), 4).alias("doubled")
    )


@query("f_record_filter", "SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase' AND value > 50", "events")
def _(events):
    return filters.keep_where(events, "event_type = 'purchase' and value > 50").select("event_id", "user_id", "value")


@query(
    "f_truthy_props",
    """SELECT event_id, CASE WHEN NOT json_exists(props, '$.k') THEN false WHEN json_extract_string(props, '$.k') IS NULL THEN true
    ELSE json_extract_string(props, '$.k') NOT IN ('False', 'false', '{}', '[]', '()', '', '0', '0.0') END AS truth FROM events""",
    "events",
)
def _(events):
    return events.select("event_id", values.truthy_json(F.col("props"), "k").alias("truth"))


@query(
    "f_incremental_range",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate IS NULL OR o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-06-30'",
    "orders",
)
def _(orders):
    return filters.in_range(orders, F.col("o_orderdate"), F.lit("1995-01-01").cast("timestamp_ntz"), F.lit("1996-06-30").cast("timestamp_ntz")).select("o_orderkey", "o_custkey")


@query(
    "f_cdc_route",
    """SELECT event_id, 'delete' AS route FROM events WHERE event_type = 'error' UNION ALL SELECT event_id, 'load' AS route FROM events WHERE event_type IS DISTINCT FROM 'error'""",
    "events",
)
def _(events):
    return filters.route_deletes(events, F.col("event_type") == "error").select("event_id", "route")


@query(
    "f_conformance",
    """SELECT event_id, len(list_filter(json_keys(props), lambda k: k <> 'k')) = 0 AND coalesce(json_type(props, '$.k') IN ('BIGINT', 'UBIGINT', 'NULL', 'BOOLEAN'), true) AS fits FROM events""",
    "events",
)
def _(events):
    return events.select("event_id", filters.conforms(F.col("props"), {"k": "integer"}).alias("fits"))


@query("f_limit_ordered", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100", "orders")
def _(orders):
    return filters.first_rows(orders, 100, F.desc("o_totalprice"), "o_orderkey").select("o_orderkey", "o_totalprice")


@query("p_extract_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) <> 0", "events")
def _(events):
    return records.extract_json(events, "props", "$.k", "bigint", "k").select("event_id", "k")


@query(
    "p_extract_values",
    """SELECT conv_id, turn, text AS v FROM conversations WHERE text <> ''
    UNION ALL SELECT conv_id, turn, unnest([NULL, role]) FROM conversations WHERE turn % 4 = 1""",
    "conversations",
)
def _(conversations):
    # a text, a list that holds a null, and a zero: an empty text and the zero give no record
    body = F.to_json(F.struct(F.col("text").alias("a"), F.when(F.col("turn") % 4 == 1, F.array(F.lit(None).cast("string"), "role")).alias("b"), F.lit(0).alias("z")))
    rows = conversations.select("conv_id", "turn", body.alias("body"))
    one, two, none = (records.extract_json(rows, "body", path, "string", "v").select("conv_id", "turn", "v") for path in ("$.a", "$.b", "$.z"))
    return one.unionByName(two).unionByName(none)


@query(
    "p_expand_lines",
    """SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, lines[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL), unnest(range(1, len(lines) + 1)) AS t(i)
    UNION ALL SELECT doc_id, NULL, NULL FROM documents WHERE text IS NULL""",
    "documents",
)
def _(documents):
    return records.expand(documents.select("doc_id", "text"), F.split("text", "\n"), "line", emit_parent=True, position="line_no").drop("text")


@query(
    "p_add_fields_chain",
    """SELECT l_orderkey, l_linenumber, floor(net) AS net, floor(net * (1 + l_tax)) AS gross, CASE WHEN net * (1 + l_tax) > 50000 THEN 'large' ELSE 'small' END AS size
    FROM (SELECT *, l_extendedprice * (1 - l_discount) AS net FROM lineitem)""",
    "lineitem",
)
def _(lineitem):
    made = records.add_fields(lineitem, [("net", "l_extendedprice * (1 - l_discount)", None), ("gross", "net * (1 + l_tax)", None), ("size", "if(gross > 50000, 'large', 'small')", None)])
    return made.select("l_orderkey", "l_linenumber", F.floor("net").cast("double").alias("net"), F.floor("gross").cast("double").alias("gross"), "size")


@query("p_remove_fields", "SELECT c_custkey, c_name, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS c_acctbal FROM customer", "customer")
def _(customer):
    return records.remove_fields(records.remove_fields(customer, ["c_nationkey", "c_mktsegment", "absent"]), ["c_acctbal"], F.col("c_acctbal") < 0)


@query("p_rename_snake", "SELECT p_partkey AS part_key, p_name AS part_name, p_brand AS pbrand2, p_size AS size_of, p_type AS _type, p_retailprice AS price_ FROM part", "part")
def _(part):
    named = part.select(F.col("p_partkey").alias("PartKey"), F.col("p_name").alias("part name"), F.col("p_brand").alias("PBrand2"), F.col("p_size").alias("SizeOf"), F.col("p_type").alias("#Type"), F.col("p_retailprice").alias("price!"))
    return records.keys_replace(records.keys_to_snake(named), "brand_2", "brand2")


@query("p_flatten", "SELECT o_orderkey AS order_key, o_orderstatus AS status, o_totalprice AS total, o_custkey AS customer_key FROM orders", "orders")
def _(orders):
    nested = orders.select(
        F.struct(F.col("o_custkey").alias("key"), F.col("o_totalprice").alias("total")).alias("customer"), F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("key")).alias("order")
    )
    flat = records.flatten(nested)
    return flat.withColumnsRenamed({"key": "order_key", "customer.key": "customer_key"})


@query("p_lift", "SELECT o_orderkey, o_orderstatus AS s_status, o_totalprice AS s_total FROM orders", "orders")
def _(orders):
    nested = orders.select("o_orderkey", F.struct(F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total")).alias("s"))
    return records.lift(nested, "s", drop=True, prefix="s_")


@query(
    "p_normalize",
    "SELECT event_id, event_type AS raw, TRY_CAST(event_type AS BIGINT) AS typed, event_type IS NOT NULL AND TRY_CAST(event_type AS BIGINT) IS NULL AS cast_error FROM events",
    "events",
)
def _(events):
    return events.select("event_id", values.cast_or_keep(F.col("event_type"), "bigint").alias("x")).select("event_id", "x.*")


@query("p_name_normalize", "SELECT n_nationkey, regexp_replace(lower(n_name), '[^a-z0-9]', '_', 'g') AS name FROM nation", "nation")
def _(nation):
    return nation.select("n_nationkey", text.normal_name(F.col("n_name")).alias("name"))


@query("p_remap", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS status FROM orders", "orders")
def _(orders):
    return orders.select("o_orderkey", values.remap(F.col("o_orderstatus"), {"F": "finished", "O": "open"}).alias("status"))


@query(
    "j_substream",
    """SELECT o_orderkey, c_custkey AS customer, c_mktsegment AS parent_c_mktsegment FROM customer JOIN orders ON o_custkey = c_custkey""",
    "customer",
    "orders",
)
def _(customer, orders):
    return joins.substream(customer, orders, "c_custkey", "o_custkey", "customer", ["c_mktsegment"]).select("o_orderkey", "customer", "parent_c_mktsegment")


@query(
    "j_chunk_merge",
    """SELECT p_partkey, p_name, CASE WHEN p_partkey % 2 = 0 THEN p_size + 1 ELSE p_size END AS p_size, p_brand FROM part""",
    "part",
)
def _(part):
    one = part.select("p_partkey", "p_name", "p_size")
    two = part.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.col("p_size") + 1).alias("p_size"), "p_brand")
    return joins.merge_chunks([one, two], ["p_partkey"])


@query("r_list_product", "SELECT r_name, n_name FROM region CROSS JOIN nation", "region", "nation")
def _(region, nation):
    return slices.product(region.select("r_name"), nation.select("n_name"))


@query(
    "r_union_dedupe",
    """SELECT child, "position", nation FROM (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY child, "position") AS r FROM (
    SELECT 0 AS child, c_custkey AS "position", c_nationkey AS nation FROM customer UNION ALL SELECT 1, s_suppkey, s_nationkey FROM supplier)) WHERE r = 1""",
    "customer",
    "supplier",
)
def _(customer, supplier):
    one = customer.select(F.col("c_custkey").alias("position"), F.col("c_nationkey").alias("nation"), "c_name")
    two = supplier.select(F.col("s_suppkey").alias("position"), F.col("s_nationkey").alias("nation"), "s_name")
    return slices.union_first([one, two], "nation").select("child", "position", "nation")


@query(
    "r_grouping",
    """SELECT c_nationkey, CAST((i - 1) // 7 AS BIGINT) AS batch, string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY i) AS ids, count(*) AS n
    FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i FROM customer) GROUP BY ALL""",
    "customer",
)
def _(customer):
    out = slices.grouped(customer, "c_custkey", ["c_custkey"], 7, distinct=True, partition=["c_nationkey"])
    return out.select("c_nationkey", "batch", F.array_join(F.transform("values", lambda v: v.cast("string")), ",").alias("ids"), "n")


@query(
    "r_property_chunk",
    "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part",
    "part",
)
def _(part):
    chunked = slices.property_chunks([c for c in part.columns if c != "p_partkey"], 2, always=["p_partkey"])
    return merging.merge_chunks([part.select(*chunk) for chunk in chunked], ["p_partkey"])


@query(
    "g_offset_pages",
    """SELECT o_custkey, o_orderkey, CAST((r - 1) // 5 + 1 AS BIGINT) AS page, CAST((r - 1) // 5 * 5 AS BIGINT) AS "offset" FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders)""",
    "orders",
)
def _(orders):
    return slices.pages(orders, ["o_orderdate", "o_orderkey"], 5, first=1, partition=["o_custkey"]).select("o_custkey", "o_orderkey", "page", "offset")


@query(
    "a_max_per_slice",
    "SELECT user_id, max(ts) AS \"cursor\", false AS is_global FROM events GROUP BY user_id UNION ALL SELECT NULL, max(ts), true FROM events",
    "events",
)
def _(events):
    return state.max_cursor(events.withColumn("ts", F.col("ts").cast("timestamp")), ["user_id"], "ts")


SESSIONS = """WITH s AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) // 3600 AS a, CAST(floor(epoch(ts)) AS BIGINT) // 3600 + CAST(event_id % 5 AS BIGINT) AS b FROM events),
    f AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh FROM s),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM f),
    m AS (SELECT user_id, min(a) AS start, max(b) AS "end" FROM g GROUP BY user_id, island)"""


def merged(events: DataFrame) -> DataFrame:
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000)
    spans = events.select("user_id", hour.alias("start"), (hour + F.col("event_id") % 5).alias("end"))
    return state.merge_intervals(spans, ["user_id"], step=1)


@query("a_interval_merge", SESSIONS + " SELECT * FROM m", "events")
def _(events):
    return merged(events)


@query(
    "a_interval_gaps",
    SESSIONS + """, n AS (SELECT *, lead(start) OVER (PARTITION BY user_id ORDER BY start) AS nxt FROM m)
    SELECT user_id, "end" + 1 AS gap_start, nxt - 1 AS gap_end FROM n WHERE nxt > "end" + 1""",
    "events",
)
def _(events):
    return state.interval_gaps(merged(events), ["user_id"])


@query(
    "i_unsynced",
    SESSIONS + """, n AS (SELECT *, lead(start) OVER w AS nxt, lag("end") OVER w AS prv, greatest(max("end") OVER (PARTITION BY user_id) - 2, 0) AS tail FROM m WINDOW w AS (PARTITION BY user_id ORDER BY start)),
    open_gaps AS (SELECT user_id, CAST(0 AS BIGINT) AS start, start - 1 AS "end", tail FROM n WHERE prv IS NULL AND start > 0 UNION ALL SELECT user_id, "end" + 1, nxt - 1, tail FROM n WHERE nxt > "end" + 1)
    SELECT user_id, start, least("end", tail - 1) AS "end" FROM open_gaps WHERE start <= least("end", tail - 1)
    UNION ALL SELECT user_id, tail, CAST(1000000 AS BIGINT) FROM n WHERE nxt IS NULL AND tail < 1000000
    UNION ALL SELECT DISTINCT c_custkey, CAST(0 AS BIGINT), CAST(1000000 AS BIGINT) FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL)""",
    "events",
    "customer",
)
def _(events, customer):
    users = customer.select(F.col("c_custkey").cast(events.schema["user_id"].dataType).alias("user_id"))
    return slices.unsynced(merged(events), ["user_id"], F.lit(0).cast("long"), F.lit(1_000_000).cast("long"), step=1, lookback=2, every=users)


@query(
    "a_status_rollup",
    """SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'P') THEN 'failed' WHEN bool_or(o_orderstatus = 'O') THEN 'running' ELSE 'completed' END AS status FROM orders GROUP BY o_custkey""",
    "orders",
)
def _(orders):
    named = orders.withColumn("status", values.remap(F.col("o_orderstatus"), {"P": "failed", "O": "running", "F": "completed"}))
    return state.rollup_status(named, ["o_custkey"], "status")


@query(
    "a_format_infer",
    """SELECT o_orderpriority, bool_and(try_strptime(d, '%Y-%m-%d') IS NOT NULL) AS fits_0, bool_and(try_strptime(d, '%d/%m/%Y') IS NOT NULL) AS fits_1
    FROM (SELECT o_orderpriority, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders) GROUP BY 1""",
    "orders",
)
def _(orders):
    dated = orders.withColumn("d", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return dated.groupBy("o_orderpriority").agg(*state.formats_that_fit(F.col("d"), [dates.java_pattern("%Y-%m-%d"), dates.java_pattern("%d/%m/%Y")]))


@query(
    "a_type_infer",
    """SELECT event_type, CASE WHEN bool_and(lower(v) IN ('true','false','yes','no','y','n','t','f','on','off','1','0')) THEN 'boolean' WHEN bool_and(TRY_CAST(v AS BIGINT) IS NOT NULL) THEN 'integer' ELSE 'string' END AS k_type, 'string' AS type_type
    FROM (SELECT event_type, json_extract_string(props, '$.k') AS v FROM events) GROUP BY 1""",
    "events",
)
def _(events):
    return events.groupBy("event_type").agg(state.inferred_type(F.get_json_object("props", "$.k")).alias("k_type"), state.inferred_type(F.col("props")).alias("type_type"))


@query("a_record_counts", "SELECT event_type, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY 1", "events")
def _(events):
    return state.record_counts(events, ["event_type"])


@query("a_duplicate_names", "SELECT md5(text) AS name, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1", "documents")
def _(documents):
    return state.repeated(documents, "text").select(F.md5("text").alias("name"), "n")


@query("a_ascending", "SELECT o_custkey, coalesce(bool_and(d >= p OR p IS NULL), true) AS ascending FROM (SELECT o_custkey, o_orderdate AS d, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders) GROUP BY 1", "orders")
def _(orders):
    return state.is_ascending(orders, ["o_custkey"], "o_orderkey", "o_orderdate")


@query(
    "i_range_slices",
    """SELECT n_nationkey, s AS start, least(s + INTERVAL 10 DAY - INTERVAL 1 SECOND, TIMESTAMP '2021-03-05') AS "end"
    FROM (SELECT n_nationkey, unnest(generate_series(TIMESTAMP '2021-01-01' + to_days(n_nationkey), TIMESTAMP '2021-03-05', INTERVAL 10 DAY)) AS s FROM nation)""",
    "nation",
)
def _(nation):
    low = F.timestamp_seconds(F.lit(1609459200) + F.col("n_nationkey") * 86_400)
    spans = nation.select("n_nationkey", low.alias("low"), F.lit("2021-03-05").cast("timestamp").alias("high"))
    return slices.range_slices(spans, "low", "high", "10 DAYS", "1 SECOND").select("n_nationkey", "start", "end")


@query(
    "i_clamp",
    """SELECT o_orderkey, date_trunc('day', o_orderdate) + INTERVAL 1 DAY AS day_end, CASE WHEN day(o_orderdate) = 1 THEN date_trunc('day', o_orderdate) ELSE date_trunc('month', o_orderdate) + INTERVAL 1 MONTH END AS month_end,
    CAST(CASE WHEN isodow(o_orderdate) = 1 THEN date_trunc('day', o_orderdate) ELSE date_trunc('week', o_orderdate) + INTERVAL 7 DAY END AS TIMESTAMP) AS week_end FROM orders""",
    "orders",
)
def _(orders):
    ts = F.col("o_orderdate").cast("timestamp")
    return orders.select("o_orderkey", *(dates.ceiling(ts, u).cast("timestamp").alias(f"{u}_end") for u in ("day", "month", "week")))


@query("i_min_max_bound", "SELECT o_orderkey, CASE WHEN o_orderdate IS NOT NULL THEN least(greatest(o_orderdate, TIMESTAMP '1994-01-01'), TIMESTAMP '1997-01-01') END AS d FROM orders", "orders")
def _(orders):
    bound = lambda s: F.lit(s).cast("timestamp")
    return orders.select("o_orderkey", dates.bounded(F.col("o_orderdate").cast("timestamp"), bound("1994-01-01"), bound("1997-01-01")).alias("d"))


@query("i_lookback", "SELECT e.event_id FROM events e JOIN (SELECT user_id, max(ts) AS m FROM events GROUP BY 1) c USING (user_id) WHERE e.ts >= c.m - INTERVAL 1 DAY", "events")
def _(events):
    return filters.within_lookback(events, ["user_id"], "ts", "1 DAY").select("event_id")


@query(
    "i_history_antijoin",
    "SELECT p.url AS uri, p.page_id AS last_modified FROM pages p LEFT JOIN (SELECT url, page_id - page_id % 2 AS seen FROM pages WHERE page_id % 3 <> 0) h ON p.url = h.url WHERE h.url IS NULL OR p.page_id > h.seen",
    "pages",
)
def _(pages):
    files = pages.select(F.col("url").alias("uri"), F.col("page_id").alias("last_modified"))
    history = files.where("last_modified % 3 <> 0").withColumn("last_modified", F.col("last_modified") - F.col("last_modified") % 2)
    return joins.pending_files(files, history)


@query("i_rate_window", "SELECT date_trunc('hour', ts) AS hour, count(*) AS calls FROM events GROUP BY 1", "events")
def _(events):
    return rates.fixed_windows(events, F.col("ts").cast("timestamp"), "1 hour").withColumnRenamed("start", "hour")


@query(
    "i_rate_moving",
    "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) AS calls FROM (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events)",
    "events",
)
def _(events):
    return rates.moving_windows(events, ["user_id"], F.floor(dates.epoch_seconds(F.col("ts"))), 3600).select("event_id", "calls")


@query(
    "k_merge_upsert",
    """SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 4 <> 0
    UNION ALL SELECT c_custkey + CASE WHEN c_custkey % 8 = 0 THEN 1000000 ELSE 0 END, c_name, c_acctbal + 2 FROM customer WHERE c_custkey % 4 = 0
    UNION ALL SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 8 = 0""",
    "customer",
)
def _(customer):
    # two new rows for each key, the larger one wins; half of the new keys are unknown
    target = customer.select("c_custkey", "c_name", "c_acctbal")
    key_ = F.col("c_custkey") + F.when(F.col("c_custkey") % 8 == 0, 1_000_000).otherwise(0)
    fresh = target.where("c_custkey % 4 = 0").withColumn("c_custkey", key_)
    new = fresh.withColumn("c_acctbal", F.col("c_acctbal") + 2).unionByName(fresh.withColumn("c_acctbal", F.col("c_acctbal") + 1))
    return loading.merge(target, new, ["c_custkey"], F.col("c_acctbal"))


@query("k_append", "SELECT n_nationkey, n_name, NULL AS note FROM nation UNION ALL SELECT n_nationkey, n_name, 'again' FROM nation", "nation")
def _(nation):
    rows = nation.select("n_nationkey", "n_name")
    return loading.append(rows.withColumn("note", F.lit(None).cast("string")), rows.withColumn("note", F.lit("again")))


@query("k_load_columns", "SELECT n_nationkey, sha256(CAST(n_nationkey AS VARCHAR)) AS _raw_id, TIMESTAMP '2024-01-01' AS _extracted_at, '{}' AS _meta FROM nation", "nation")
def _(nation):
    return loading.with_load_columns(nation, ["n_nationkey"], F.lit("2024-01-01").cast("timestamp")).select("n_nationkey", "_raw_id", "_extracted_at", "_meta")


@query(
    "k_documents",
    "SELECT concat('ns_docs_', doc_id) AS record_id, concat_ws(chr(10), 'text: ' || text, 'lang: ' || lang) AS content, source AS source FROM documents",
    "documents",
)
def _(documents):
    return loading.documents(documents, ["text", "lang"], ["source"], ["doc_id"], "docs", "ns").select("record_id", "content", F.col("metadata")["source"].alias("source"))


@query(
    "k_chunks",
    """WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(trim(text, chr(32) || chr(9) || chr(10) || chr(13)), '[ \\t\\n\\r]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
    c AS (SELECT doc_id, w, unnest(range(0, greatest(1, CAST(ceil((len(w) - 64) / 48.0) AS BIGINT) + 1))) AS chunk FROM w WHERE len(w) > 0)
    SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, array_to_string(w[chunk * 48 + 1 : chunk * 48 + 64], ' ') AS content FROM c""",
    "documents",
)
def _(documents):
    return loading.chunks(documents, "text", 64, 16, ["doc_id"])


@query(
    "k_embedding_check",
    "SELECT vec_id, coalesce(len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0, false) AS fits FROM embeddings",
    "embeddings",
)
def _(embeddings):
    return embeddings.select("vec_id", loading.checked_embedding(F.col("embedding"), 64).alias("fits"))


@query("n_hash", "SELECT c_custkey, md5(c_name) AS m, md5(concat(c_name, 'x')) AS salted, sha256(c_name) AS s, sha256(concat('seed', c_name)) AS one_way FROM customer", "customer")
def _(customer):
    name = F.col("c_name")
    return customer.select(
        "c_custkey", text.digest(name).alias("m"), text.digest(name, salt="x").alias("salted"), text.digest(name, "sha256").alias("s"), text.one_way_hash(name, "seed").alias("one_way")
    )


@query("n_base64", "SELECT c_custkey, base64(encode(c_name)) AS coded, decode(from_base64(base64(encode(c_name)))) AS decoded FROM customer", "customer")
def _(customer):
    coded = text.base64_encode(F.col("c_name"))
    return customer.select("c_custkey", coded.alias("coded"), text.base64_decode(coded).alias("decoded"))


@query(
    "n_regex",
    r"SELECT page_id, regexp_extract(url, '://([^/]+)/', 1) AS host, regexp_replace(url, '(\w+)://', '\1:', 'g') AS short FROM pages",
    "pages",
)
def _(pages):
    url = F.col("url")
    return pages.select("page_id", text.search(url, "://([^/]+)/").alias("host"), text.replace(url, r"(\w+)://", r"\1:").alias("short"))


@query(
    "n_datetime",
    """SELECT event_id, epoch_us(ts) / 1000000.0 AS seconds, strftime(ts, '%Y-%m-%d %H:%M:%S') AS shown, CAST(epoch_us(ts) // 1000 AS VARCHAR) AS ms, date_trunc('second', ts) AS parsed FROM events""",
    "events",
)
def _(events):
    ts = F.col("ts").cast("timestamp")
    shown = dates.render(ts, "%Y-%m-%d %H:%M:%S")
    return events.select(
        "event_id", dates.epoch_seconds(ts).alias("seconds"), shown.alias("shown"), dates.render(ts, "%ms").alias("ms"), dates.parse(shown, "%d/%m/%Y", "%Y-%m-%d %H:%M:%S").alias("parsed")
    )


@query("n_snake", "SELECT p_partkey, lower(regexp_replace(replace(p_name, ' ', ''), '(.)([A-Z])', '\\1_\\2', 'g')) AS name FROM part", "part")
def _(part):
    return part.select("p_partkey", text.snake(F.replace("p_name", F.lit(" "), F.lit(""))).alias("name"))


@query("n_url", "SELECT page_id, replace(url_encode(url), '%20', '+') AS quoted, replace(url_encode(html), '%20', '+') AS body FROM pages", "pages")
def _(pages):
    return pages.select("page_id", text.url_quote(F.col("url")).alias("quoted"), text.url_quote(F.col("html")).alias("body"))


@query(
    "n_strtobool",
    "SELECT o_orderkey, CASE WHEN lower(o_orderstatus) IN ('y','yes','t','true','on','1') THEN true WHEN lower(o_orderstatus) IN ('n','no','f','false','off','0') THEN false END AS flag FROM orders",
    "orders",
)
def _(orders):
    return orders.select("o_orderkey", values.to_bool(F.col("o_orderstatus")).alias("flag"))


@query("n_bounds", "SELECT p_partkey, greatest(p_size, 10) AS at_least, least(p_size, 40) AS at_most FROM part", "part")
def _(part):
    return part.select("p_partkey", F.greatest("p_size", F.lit(10)).alias("at_least"), F.least("p_size", F.lit(40)).alias("at_most"))


@query(
    "h_actions",
    """SELECT event_id, CASE WHEN s BETWEEN 200 AND 399 THEN 'success' WHEN s = 429 THEN 'rate_limited' WHEN s IN (408, 500, 502, 503, 504) OR s >= 500 THEN 'retry' ELSE 'fail' END AS action, 5.0 * pow(2.0, event_id % 4) AS wait
    FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 200 WHEN 1 THEN 429 WHEN 2 THEN 503 WHEN 3 THEN 404 ELSE 301 END AS s FROM events)""",
    "events",
)
def _(events):
    at = F.col("event_id") % 5
    status = F.when(at == 0, 200).when(at == 1, 429).when(at == 2, 503).when(at == 3, 404).otherwise(301)
    return events.select("event_id", http.action(status).alias("action"), http.exponential_wait((F.col("event_id") % 4).cast("double")).alias("wait"))


@query(
    "o_files_by_time",
    "SELECT page_id % 50 AS last_modified, string_agg(url, ' ' ORDER BY url) AS uris, count(*) AS n FROM pages GROUP BY 1",
    "pages",
)
def _(pages):
    files = joins.by_modified(pages.select(F.col("url").alias("uri"), (F.col("page_id") % 50).alias("last_modified")))
    return files.select("last_modified", F.array_join("uris", " ").alias("uris"), F.size("uris").cast("long").alias("n"))


@query(
    "o_newest_per_key",
    "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 2",
    "orders",
)
def _(orders):
    return filters.newest_by(orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 2).select("o_custkey", "o_orderkey")


@query("o_history_evict", "SELECT url AS uri, page_id AS last_modified FROM pages ORDER BY page_id DESC, url DESC LIMIT 30", "pages")
def _(pages):
    return state.evict(pages.select(F.col("url").alias("uri"), F.col("page_id").alias("last_modified")), 30)


@query("o_intersect", "SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier", "customer", "supplier")
def _(customer, supplier):
    return customer.select(F.col("c_nationkey").alias("nation")).intersect(supplier.select("s_nationkey"))


@query("o_except", "SELECT c_nationkey AS nation FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_suppkey % 3 = 0", "customer", "supplier")
def _(customer, supplier):
    return customer.select(F.col("c_nationkey").alias("nation")).subtract(supplier.where("s_suppkey % 3 = 0").select("s_nationkey"))


@query(
    "j_embedded_children",
    "SELECT o_custkey, o_orderkey, o_totalprice FROM orders",
    "orders",
)
def _(orders):
    rows = orders.select("o_custkey", "o_orderkey", "o_totalprice").withColumn("at", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    parents = rows.where("at <= 3").groupBy("o_custkey").agg(F.collect_list(F.struct("o_orderkey", "o_totalprice")).alias("first_page"))
    return joins.embedded_children(parents, "first_page", ["o_custkey"], rows.where("at > 3").drop("at"))


@query("n_stream_name", "SELECT c_custkey, lower(regexp_replace(regexp_replace(c_name, '(.)([A-Z][a-z]+)', '\\1_\\2', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')) AS name FROM customer", "customer")
def _(customer):
    return customer.select("c_custkey", text.stream_name(F.col("c_name")).alias("name"))


@query(
    "i_state_start",
    "SELECT user_id, coalesce(max(CASE WHEN event_type = 'purchase' THEN ts END), max(CASE WHEN event_type = 'click' THEN ts END), TIMESTAMP '2020-01-01') AS start FROM events GROUP BY 1",
    "events",
)
def _(events):
    by = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("ts").cast("timestamp")))
    rows = events.groupBy("user_id").agg(by("purchase").alias("most_recent"), by("click").alias("end"))
    made = F.array(F.struct(F.lit(None).cast("timestamp").alias("start"), "end", "most_recent"))
    return rows.select("user_id", state.start_from_state(made, F.lit("2020-01-01").cast("timestamp"), F.lit("1970-01-01").cast("timestamp")).alias("start"))


@query(
    "a_schema_infer",
    """SELECT event_type, CASE WHEN bool_or(json_type(props, '$.k') IN ('BIGINT', 'UBIGINT')) THEN 'OBJECT<k: BIGINT, tags: ARRAY<STRING>>' ELSE 'OBJECT<k: VOID, tags: ARRAY<STRING>>' END AS "schema" FROM events GROUP BY 1""",
    "events",
)
def _(events):
    nested = F.to_json(F.struct(key(events).alias("k"), F.array("event_type").alias("tags")), {"ignoreNullFields": "false"})
    return state.inferred_schema(events.select("event_type", nested.alias("body")), "body", ["event_type"])


#: Columns of ``orders`` that round trips carry, as text.
ORDER_SQL = "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders"


def saved(df: DataFrame, kind: str, **options: str) -> str:
    path = scratch.folder(df.sparkSession, kind)
    df.write.format(kind).options(**options).save(path)
    return path


@query("s_csv", ORDER_SQL, "orders")
def _(orders):
    rows = orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    read = files.read_csv(orders.sparkSession, saved(rows, "csv", header="true", compression="gzip"))
    return files.cast_csv(read, files.infer_csv(read)).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("s_csv_below", "SELECT n_nationkey, n_name FROM nation", "nation")
def _(nation):
    line = F.concat_ws(",", F.col("n_nationkey").cast("string"), "n_name")
    body = nation.coalesce(1).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("v")).select(F.concat(F.lit("made today\nn_nationkey,n_name\n"), "v").alias("value"))
    read = files.read_csv_below(nation.sparkSession, saved(body, "text"), before_header=1)
    return read.select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name")


@query("s_jsonl", ORDER_SQL, "orders")
def _(orders):
    rows = orders.select(F.to_json(F.struct("o_orderkey", "o_orderstatus", "o_totalprice")).alias("value"))
    broken = rows.limit(1).select(F.lit('{"o_orderkey": 1, ').alias("value"))
    path = saved(rows.unionByName(broken), "text")
    return files.read_jsonl(orders.sparkSession, path, "o_orderkey bigint, o_orderstatus string, o_totalprice double").select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("s_jsonl_schemaless", "SELECT o_orderkey FROM orders", "orders")
def _(orders):
    path = saved(orders.select(F.to_json(F.struct("o_orderkey")).alias("value")), "text", compression="gzip")
    return files.read_jsonl(orders.sparkSession, path).select(F.get_json_object("data", "$.o_orderkey").cast("bigint").alias("o_orderkey"))


@query("s_parquet", "SELECT p_partkey, p_name, CAST(p_size AS DOUBLE) AS size FROM part UNION ALL SELECT p_partkey, p_name, p_retailprice FROM part", "part")
def _(part):
    one, two = (saved(part.select("p_partkey", "p_name", F.col(c).alias("size")), "parquet") for c in ("p_size", "p_retailprice"))
    return files.read_parquet(part.sparkSession, one, two).select("p_partkey", "p_name", "size")


@query("s_documents", "SELECT string_agg(n_name, chr(10) ORDER BY n_name) || chr(10) AS content, 'txt' AS ending FROM nation", "nation")
def _(nation):
    read = files.read_documents(nation.sparkSession, saved(nation.select("n_name").coalesce(1).sortWithinPartitions("n_name"), "text")).where("parse_error is null")
    return read.select("content", F.element_at(F.split("document_key", r"\."), -1).alias("ending"))


@query("s_listing", "SELECT o_orderstatus AS status, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_orderstatus", "orders")
def _(orders):
    spark = orders.sparkSession
    path = scratch.folder(spark, "listing")
    orders.repartition("o_orderstatus").write.partitionBy("o_orderstatus").parquet(path)
    found = files.listing(spark, path, "*.parquet", since="2000-01-01").where("uri not like '%o_orderstatus=P/%' and size > 0")
    rows = files.with_file_columns(spark.read.parquet(path)).join(F.broadcast(found), F.col(files.URL) == F.col("uri"))  # a row a file
    return rows.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query("x_json", "SELECT conv_id, turn, text FROM conversations", "conversations")
def _(conversations):
    whole = conversations.groupBy("conv_id").agg(F.to_json(F.collect_list(F.struct("turn", "text"))).alias("body"))
    return decoders.json_records(whole, "body", "struct<turn: bigint, text: string>").select("conv_id", F.col("record.turn").cast(conversations.schema["turn"].dataType).alias("turn"), "record.text")


@query("x_json_lines", "SELECT conv_id, turn, text FROM conversations", "conversations")
def _(conversations):
    line = F.to_json(F.struct("turn", "text"))
    whole = conversations.groupBy("conv_id").agg(F.array_join(F.array_append(F.collect_list(line), F.lit("{broken")), "\n").alias("body"))
    return decoders.json_lines(whole, "body", "turn bigint, text string").select("conv_id", F.col("record.turn").cast(conversations.schema["turn"].dataType).alias("turn"), "record.text")


@query("x_csv", "SELECT conv_id, turn, CASE WHEN text <> '' THEN text END AS text FROM conversations", "conversations")
def _(conversations):
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws(",", quoted(F.col("text")), F.col("turn").cast("string"))
    whole = conversations.groupBy("conv_id").agg(F.concat(F.lit("text,turn\r\n"), F.array_join(F.collect_list(line), "\r\n")).alias("body"))
    found = decoders.csv_records(whole, "body", ["turn", "text"], nulls=[""])
    return found.select("conv_id", F.col("record.turn").cast(conversations.schema["turn"].dataType).alias("turn"), "record.text")


@query("x_xml", "SELECT c_custkey, c_name FROM customer", "customer")
def _(customer):
    body = F.concat(F.lit("<c><name>"), "c_name", F.lit("</name></c>"))
    return decoders.xml_records(customer.select("c_custkey", body.alias("body")), "body", "name string").select("c_custkey", F.col("record.name").alias("c_name"))


@query("x_lines", "SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents", "documents")
def _(documents):
    return decoders.lines(documents.select("doc_id", "text"), "text").select("doc_id", F.col("record.record").alias("line"))


@query("x_gzip", "SELECT doc_id, replace(text, chr(0), '') AS text FROM documents", "documents")
def _(documents):
    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else gzip.compress(t.encode()))

    body = F.when(F.col("doc_id") % 3 == 0, F.encode("text", "utf-8")).otherwise(packed("text"))
    path = saved(documents.select("doc_id", body.alias("body")), "parquet")
    read = documents.sparkSession.read.parquet(path)
    return read.select("doc_id", decoders.text_of(F.col("body")).alias("text"))


@query("x_dispatch", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN upper(c_name) ELSE c_name END AS name FROM customer", "customer")
def _(customer):
    xml = F.concat(F.lit("<r><name>"), F.upper("c_name"), F.lit("</name></r>"))
    body = F.when(F.col("c_custkey") % 4 == 0, xml).when(F.col("c_custkey") % 4 == 2, F.to_json(F.struct(F.upper("c_name").alias("name")))).otherwise(F.col("c_name"))
    kind = F.when(F.col("c_custkey") % 4 == 0, "application/xml").when(F.col("c_custkey") % 4 == 2, "application/json").otherwise("text/plain")
    rows = customer.select("c_custkey", F.encode(body, "utf-8").alias("body"), kind.alias("kind")).withColumn("text", decoders.text_of(F.col("body")))
    by = {"application/xml": F.from_xml("text", "name string")["name"], "application/json": F.from_json("text", "name string")["name"]}
    return rows.select("c_custkey", decoders.dispatch(rows, "kind", by, F.col("text")).alias("name"))


@query("p_schemaless", "SELECT n_nationkey, n_name FROM nation", "nation")
def _(nation):
    whole = records.schemaless(nation)
    return whole.select(F.get_json_object("data", "$.n_nationkey").cast("int").alias("n_nationkey"), F.get_json_object("data", "$.n_name").alias("n_name"))


@query("p_keys_lower", "SELECT n_nationkey, n_name FROM nation", "nation")
def _(nation):
    return records.keys_to_lower(nation.select(F.col("n_nationkey").alias("N_NationKey"), F.col("n_name").alias("N_NAME")))


@query("i_state_migration", "SELECT user_id, max(ts) AS \"cursor\" FROM events WHERE user_id IS NOT NULL GROUP BY 1", "events")
def _(events):
    last = events.where("user_id is not null").groupBy("user_id").agg(F.max(F.col("ts").cast("timestamp")).alias("m"))
    legacy = last.select(F.create_map(F.col("user_id").cast("string"), "m").alias("state"))
    parts = legacy.select(F.explode(state.legacy_to_partitions(F.col("state"), "user_id", "ts")).alias("p"))
    return parts.select(F.col("p.partition")["user_id"].cast(events.schema["user_id"].dataType).alias("user_id"), F.col("p.cursor")["ts"].alias("cursor"))


@query(
    "i_sync",
    SESSIONS.replace("FROM events)", "FROM events WHERE event_id % 2 = 0)", 1)
    # the last end is read again
    + """, l AS (SELECT *, max("end") OVER (PARTITION BY user_id) AS last FROM m)
    SELECT event_id FROM (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) // 3600 AS h FROM events) e
    WHERE h IS NULL OR h BETWEEN 0 AND 1000000 AND NOT EXISTS (SELECT 1 FROM l WHERE l.user_id = e.user_id AND e.h BETWEEN l.start AND l."end" AND e.h <> l.last)""",
    "events",
)
def _(events):
    read, _state = synced(events)
    return read.select("event_id")


@query(
    "i_sync_state",
    "SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS start, CAST(1000000 AS BIGINT) AS \"end\" FROM events",
    "events",
)
def _(events):
    return synced(events)[1].select("user_id", "start", "end")


@query(
    "i_sync_lookback",
    # the last 400 hours of each user are read again, across intervals and gaps; events without a user are a partition
    SESSIONS.replace("SELECT user_id,", "SELECT nullif(user_id, 3) AS user_id,", 1).replace("FROM events)", "FROM events WHERE event_id % 2 = 0)", 1)
    + """, l AS (SELECT *, max("end") OVER (PARTITION BY user_id) AS last FROM m)
    SELECT event_id, user_id FROM (SELECT event_id, nullif(user_id, 3) AS user_id, CAST(floor(epoch(ts)) AS BIGINT) // 3600 AS h FROM events) e
    WHERE h IS NULL OR h BETWEEN 0 AND 1000000 AND NOT EXISTS (SELECT 1 FROM l WHERE l.user_id IS NOT DISTINCT FROM e.user_id AND e.h BETWEEN l.start AND l."end" AND e.h < l.last - 400)""",
    "events",
)
def _(events):
    read, _state = synced(events.withColumn("user_id", F.nullif("user_id", F.lit(3))), lookback=400)
    return read.select("event_id", "user_id")


@query(
    "s_avro",
    """SELECT o_orderkey, o_orderstatus, CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS DOUBLE) AS price, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS priority,
              o_custkey AS customer, CAST(len(string_split(o_comment, ' ')) AS INTEGER) AS words, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS at FROM (SELECT *, o_orderpriority || ' ' || o_orderstatus AS o_comment FROM orders)""",
    "orders",
)
def _(orders):
    spark = orders.sparkSession
    path = scratch.folder(spark, "avro")
    avro.register(spark)
    made = orders.select(
        "o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").alias("price"), F.col("o_orderdate").cast("date").alias("day"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")).alias("priority"), F.struct(F.col("o_custkey").alias("key")).alias("customer"),
        F.split(F.concat_ws(" ", "o_orderpriority", "o_orderstatus"), " ").alias("words"), F.map_from_arrays(F.array(F.lit("at")), F.array(F.col("o_orderdate").cast("timestamp_ntz"))).alias("times"),
    )
    made.write.format("avro_files").option("path", path).mode("append").save()
    back = avro.read_avro(spark, path, split=1 << 18)
    at = F.date_format(F.col("times")["at"], "yyyy-MM-dd HH:mm:ss").alias("at")
    return back.select("o_orderkey", "o_orderstatus", F.col("price").cast("double").alias("price"), F.col("day").cast("string").alias("day"), "priority", F.col("customer.key").alias("customer"), F.size("words").alias("words"), at)


@query(
    "s_excel",
    """SELECT CAST(o_orderkey AS DOUBLE) AS "Key", o_orderpriority AS "Priority", CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS "Price", strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS "Placed", o_orderstatus = 'O' AS "Open",
       CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE CAST(o_custkey AS VARCHAR) END AS "Mixed" FROM orders""",
    "orders",
)
def _(orders):
    spark = orders.sparkSession
    path = scratch.folder(spark, "excel")

    def book(rows: pd.DataFrame) -> pd.DataFrame:
        head = ["Key", "Priority", "Price", "Placed", "Open", "Mixed"]
        lines = ([int(r.k), r.p, None if pd.isna(r.price) else float(r.price), r.at.to_pydatetime(), bool(r.open), r.s if r.k % 2 == 0 else int(r.c)] for r in rows.itertuples())
        return pd.DataFrame({"path": [f"{rows['book'].iloc[0]}.xlsx"], "content": [excel.workbook([head, *lines])]})

    price = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("price")
    columns = [F.floor(F.col("o_orderkey") / 2000).alias("book"), F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("p"), price]
    columns += [F.col("o_orderdate").alias("at"), (F.col("o_orderstatus") == "O").alias("open"), F.col("o_orderstatus").alias("s"), F.col("o_custkey").alias("c")]
    orders.select(*columns).groupBy("book").applyInPandas(book, "path string, content binary").write.parquet(path)  # 2,000 keys a workbook
    rows = excel.sheet_cells(spark.read.parquet(path))
    return excel.typed(rows, excel.schema_of(rows)).withColumn("Placed", F.date_format("Placed", "yyyy-MM-dd HH:mm:ss"))


@query(
    "x_json_items",
    """SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders""",
    "orders",
)
def _(orders):
    spark = orders.sparkSession
    path = scratch.folder(spark, "json-items")

    def document(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": ['{"meta": {"rows": [0]}, "data": {"note": "[{", "rows": [']})
        first = True
        for b in batches:
            if len(b):
                yield pd.DataFrame({"value": [("" if first and i == 0 else ", ") + v for i, v in enumerate(b["value"])]})
                first = False
        yield pd.DataFrame({"value": ["]}}"]})

    lines = orders.select(F.to_json(F.struct("o_orderkey", "o_orderstatus", "o_totalprice")).alias("value"))
    lines.mapInPandas(document, "value string").write.option("compression", "gzip").text(path)  # a document a task
    json_items.register(spark)
    items = spark.read.format("json_items").options(path=path, items="data.rows").load()
    kind = ", ".join(f"{n} {orders.schema[n].dataType.simpleString()}" for n in ("o_orderkey", "o_orderstatus", "o_totalprice"))
    return items.select(F.from_json("item", kind).alias("r")).select("r.*")


@query(
    "i_partition_cursors",
    # a slice an order; those of every 97th key never close, so nothing after the first of them counts
    """SELECT o_orderpriority AS stream, CAST(o_custkey % 40 AS VARCHAR) AS part, max(CAST(round(o_totalprice * 100) AS BIGINT)) AS cursor
    FROM (SELECT *, min(CASE WHEN o_orderkey % 97 = 0 THEN o_orderkey END) OVER (PARTITION BY o_orderpriority, o_custkey % 40) AS first_open FROM orders)
    WHERE first_open IS NULL OR o_orderkey < first_open GROUP BY 1, 2""",
    "orders",
)
def _(orders):
    spark = orders.sparkSession
    kinds = F.array(*(F.struct(F.lit(i).alias("at"), F.lit(k).alias("kind")) for i, k in enumerate(("open", "record", "close"))))
    steps = orders.select("*", F.explode(kinds).alias("e")).where("e.kind <> 'close' or o_orderkey % 97 <> 0")
    events = steps.select(
        F.col("o_orderpriority").alias("stream"),
        (F.col("o_orderkey") * 3 + F.col("e.at")).cast("long").alias("n"),
        "e.kind",
        (F.col("o_custkey") % 40).cast("string").alias("partition"),
        F.col("o_orderkey").cast("long").alias("slice"),
        F.lit(False).alias("last"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("cursor"),
        F.lit(None).cast("string").alias("parent"),
    )
    places = [scratch.folder(spark, f"cursors-{name}") for name in ("events", "states", "checkpoint")]
    events.write.parquet(places[0])
    states = partitions.states_after(spark, spark.readStream.schema(partitions.EVENTS).parquet(places[0]), *places[1:])
    held = F.from_json("state", "states array<struct<partition: string, cursor: bigint>>")["states"]
    return states.select("stream", F.explode(held).alias("s")).select("stream", F.col("s.partition").alias("part"), "s.cursor")


@query(
    "p_keys_scripts",
    "SELECT p_partkey AS part_key, p_name AS grosse, p_brand AS zh, p_size AS u_26085_u_26412, p_type AS onoma_2, p_size AS ka_ta FROM part",
    "part",
)
def _(part):
    inner = F.struct(F.col("p_size").alias("\u304b-\u305f"))
    named = part.select(
        F.col("p_partkey").alias("PartKey"), F.col("p_name").alias("Gr\u00f6\u00dfe"), F.col("p_brand").alias("\u0416"), F.col("p_size").alias("\u65e5-\u672c"), F.col("p_type").alias("\u038c\u03bd\u03bf\u03bc\u03b12"), inner.alias("Caf\u00e9")
    )
    return records.keys_to_snake(named).select("part_key", "grosse", "zh", "u_26085_u_26412", "onoma_2", F.col("cafe.ka_ta").alias("ka_ta"))


def synced(events: DataFrame, lookback: int = 0) -> tuple[DataFrame, DataFrame]:
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000)
    rows, users = events.select("event_id", "user_id", hour.alias("h")), events.select("user_id").distinct()
    whole = [F.lit(x).cast("long") for x in (0, 1_000_000)]
    return incremental.sync(rows, merged(events.where("event_id % 2 = 0")), ["user_id"], "h", *whole, lookback=lookback, partitions=users)


PARTS = """SELECT o_orderkey, [{'code': 'p', 'tags': [o_orderpriority, o_orderstatus], 'v': {'n': o_custkey}}, {'code': 'q', 'tags': CASE WHEN o_orderkey % 3 <> 0 THEN [CAST(o_custkey AS VARCHAR)] ELSE [] END, 'v': NULL}] AS parts FROM orders"""


def nested(orders: DataFrame) -> DataFrame:
    """Orders with lists of structs of lists, and a map of structs."""
    spare = F.when(F.col("o_orderkey") % 3 != 0, F.array(F.col("o_custkey").cast("string"))).otherwise(F.array().cast("array<string>"))
    part = lambda code, tags, v: F.struct(F.lit(code).alias("code"), tags.alias("tags"), v.alias("v"))
    inner = F.struct(F.col("o_custkey").alias("n"))
    parts = F.array(part("p", F.array("o_orderpriority", "o_orderstatus"), inner), part("q", spare, F.lit(None).cast("struct<n: bigint>")))
    more = F.create_map(F.lit("one"), F.struct(F.col("o_totalprice").alias("v")), F.lit("two"), F.struct((-F.col("o_totalprice")).alias("v")))
    return orders.select("o_orderkey", F.struct(parts.alias("parts"), more.alias("more")).alias("body"))


@query(
    "p_extract_wild",
    f"WITH n AS ({PARTS}) SELECT o_orderkey, unnest(list_concat(parts[1].tags, parts[2].tags)) AS record FROM n UNION ALL SELECT o_orderkey, CAST(parts[1].v.n AS VARCHAR) FROM n",
    "orders",
)
def _(orders):
    rows = nested(orders)
    tags, numbers = paths.extract_at(rows, "body.parts.*.tags.*", keep=["o_orderkey"]), paths.extract_at(rows, "body.**.n", keep=["o_orderkey"])
    return tags.unionByName(numbers.withColumn("record", F.col("record").cast("string")))


@query(
    "p_expand_wild",
    f"WITH n AS ({PARTS}) SELECT o_orderkey, unnest(parts[2].tags) AS tag, 2 AS n_parts FROM n WHERE len(parts[2].tags) > 0 UNION ALL SELECT o_orderkey, NULL, 2 FROM n WHERE len(parts[2].tags) = 0",
    "orders",
)
def _(orders):
    out = paths.expand_at(nested(orders), "body.parts.1.tags", "tag", emit_parent=True, original="was")
    return out.select("o_orderkey", "tag", F.size("was.body.parts").alias("n_parts"))


@query(
    "p_remove_wild",
    f"""WITH n AS ({PARTS}) SELECT o_orderkey, '{{"parts":[{{"tags":["' || parts[1].tags[1] || '","' || parts[1].tags[2] || '"]}},{{"tags":[' || CASE WHEN len(parts[2].tags) > 0 THEN '"' || parts[2].tags[1] || '"' ELSE '' END
    || ']}}],"more":{{"one":{{}}}}}}' AS body FROM n""",
    "orders",
)
def _(orders):
    rows = paths.remove_at(paths.change_at(nested(orders), "body.more.*.v", lambda value, kind: F.lit(None).cast(kind)), "body.parts.*.code", "body.parts.*.v", "body.more.tw*")
    return rows.select("o_orderkey", F.to_json("body").alias("body"))


@query(
    "p_set_nested",
    """SELECT o_orderkey, o_custkey + 1 AS n, o_orderstatus AS made, CASE WHEN o_orderkey % 3 <> 0 THEN 'x' END AS third FROM orders""",
    "orders",
)
def _(orders):
    third = F.when(F.col("o_orderkey") % 3 != 0, F.lit("x"))
    rows = paths.change_at(nested(orders).join(orders.select("o_orderkey", "o_orderstatus"), "o_orderkey"), "body.parts.0.v.n", lambda value, kind: value + 1)
    rows = paths.set_at(paths.set_at(rows, "fresh.inner.made", F.col("o_orderstatus")), "body.parts.1.tags.2", third)
    return rows.select("o_orderkey", F.col("body.parts")[0].v.n.alias("n"), F.col("fresh.inner.made").alias("made"), F.col("body.parts")[1].tags[2].alias("third"))


@query(
    "p_lift_wild",
    """SELECT o_orderkey, o_custkey AS in_key, o_orderstatus AS in_status FROM orders""",
    "orders",
)
def _(orders):
    deep = F.struct(F.struct(F.struct(F.col("o_custkey").alias("key"), F.col("o_orderstatus").alias("status")).alias("leaf")).alias("mid")).alias("top")
    return paths.lift_at(orders.select("o_orderkey", deep), "top.*.leaf", prefix="in_").drop("top")


@query(
    "p_variant_wild",
    f"WITH n AS ({PARTS}) SELECT o_orderkey, unnest(list_concat(parts[1].tags, parts[2].tags)) AS v FROM n UNION ALL SELECT o_orderkey, CAST(parts[1].v.n AS VARCHAR) FROM n",
    "orders",
)
def _(orders):
    rows = nested(orders).select("o_orderkey", F.to_json("body").alias("text"))
    both = [paths.variant_values(rows, "text", path, "v", depth=3) for path in ("parts.*.tags.*", "**.n")]
    return both[0].unionByName(both[1]).select("o_orderkey", F.try_variant_get("v", "$", "string").alias("v"))


@query(
    "a_schema_lattice",
    """SELECT event_type AS kind, 'props.k' AS path, array_to_string(list_sort(list(DISTINCT CASE WHEN user_id % 5 = 0 THEN 'string' WHEN k IS NULL THEN 'null' ELSE 'number' END)), ',') AS kinds
    FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events) WHERE json_exists(props, '$.k') GROUP BY event_type
    UNION ALL SELECT event_type, 'list[]', array_to_string(list_sort(list(DISTINCT CASE WHEN event_id % 2 = 0 THEN 'boolean' ELSE 'number' END)), ',') FROM events GROUP BY event_type""",
    "events",
)
def _(events):
    k = F.get_json_object("props", "$.k")
    shown = F.when(F.col("user_id") % 5 == 0, F.concat(F.lit('"'), F.coalesce(k, F.lit("-")), F.lit('"'))).otherwise(F.coalesce(k, F.lit("null")))
    element = F.when(F.col("event_id") % 2 == 0, F.lit("true")).otherwise(F.col("event_id").cast("string"))
    inner = F.when(F.try_variant_get(F.try_parse_json("props"), "$.k", "variant").isNotNull(), F.concat(F.lit('{"k":'), shown, F.lit("}"))).otherwise(F.lit("{}"))
    body = F.concat(F.lit('{"props":'), inner, F.lit(',"list":['), element, F.lit("]}"))
    found = schemas.places(events.select(F.col("event_type").alias("kind"), body.alias("body")), "body", ["kind"])
    return found.where("path in ('props.k', 'list[]')").withColumn("kinds", F.array_join("kinds", ","))


@query(
    "j_deep_merge",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'late' ELSE o_orderstatus END AS status, o_totalprice AS price, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS customer FROM orders""",
    "orders",
)
def _(orders):
    one = orders.select("o_orderkey", F.struct(F.struct(F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price")).alias("inner")).alias("s"))
    late = F.when(F.col("o_orderkey") % 2 == 0, F.lit("late"))
    two = orders.select("o_orderkey", F.struct(F.struct(late.alias("status")).alias("inner"), F.lit(None).cast("bigint").alias("customer")).alias("s"))
    three = orders.where("o_orderkey % 3 = 0").select("o_orderkey", F.struct(F.col("o_custkey").alias("customer")).alias("s"))
    out = merging.merge_chunks([one, two, three], ["o_orderkey"])
    return out.select("o_orderkey", F.col("s.inner.status").alias("status"), F.col("s.inner.price").alias("price"), F.col("s.customer").alias("customer"))


@query(
    "a_deep_merge_rows",
    """SELECT user_id, arg_max(event_type, event_id) AS kind, arg_max(value, event_id) FILTER (event_id % 3 <> 0 AND value IS NOT NULL) AS value, max(event_id) AS event_id FROM events WHERE user_id IS NOT NULL GROUP BY user_id""",
    "events",
)
def _(events):
    value = F.when(F.col("event_id") % 3 != 0, F.col("value"))
    rows = events.where("user_id is not null").select("user_id", "event_id", F.struct(F.col("event_type").alias("kind"), F.struct(value.alias("value")).alias("inner")).alias("s"))
    out = merging.merge_rows(rows, ["user_id"], ["event_id"])
    return out.select("user_id", F.col("s.kind").alias("kind"), F.col("s.inner.value").alias("value"), "event_id")


@query(
    "p_flatten_lists",
    """SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS id, o_orderpriority AS tag_0, o_orderstatus AS tag_1, CASE WHEN o_orderkey % 3 <> 0 THEN 'q' END AS first_a FROM orders""",
    "orders",
)
def _(orders):
    rows = F.when(F.col("o_orderkey") % 3 != 0, F.array(F.struct(F.lit("q").alias("a")))).otherwise(F.array().cast("array<struct<a: string>>"))
    body = F.to_json(F.struct(F.struct(F.col("o_custkey").alias("id")).alias("head"), rows.alias("rows"), F.array("o_orderpriority", "o_orderstatus").alias("tags")))
    out = merging.flat_columns(orders.select("o_orderkey", body.alias("body")), "body", keep=["o_orderkey"])
    return out.select("o_orderkey", F.col("`head.id`").alias("id"), F.col("`tags.0`").alias("tag_0"), F.col("`tags.1`").alias("tag_1"), F.col("`rows.0.a`").alias("first_a"))


@query(
    "k_index",
    """SELECT CAST(doc_id AS VARCHAR) AS record_id, CASE WHEN doc_id % 4 = 1 THEN 'again' ELSE source END AS content FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 4 = 1""",
    "documents",
)
def _(documents):
    spark = documents.sparkSession
    folder = scratch.folder(spark, "index")
    chunk = lambda rows, content: rows.select(F.lit("docs").alias("stream"), F.col("doc_id").cast("string").alias("record_id"), F.lit(0).alias("chunk"), content.alias("content"))
    index.write_batch(index.operations(chunk(documents, F.col("source"))), folder, "first")
    gone = chunk(documents.where("doc_id % 3 = 0"), F.lit("")).select("stream", "record_id")
    for _ in range(2):  # a batch that comes again changes nothing
        index.write_batch(index.operations(chunk(documents.where("doc_id % 4 = 1"), F.lit("again")), gone), folder, "second")
    return index.live(spark, folder).select("record_id", "content")


@query(
    "s_transfer",
    """SELECT c_custkey, c_name FROM customer""",
    "customer",
)
def _(customer):
    spark = customer.sparkSession
    source, target = (scratch.folder(spark, name) for name in ("transfer-from", "transfer-to"))
    customer.select("c_custkey", "c_name").write.parquet(source)
    copied = transfer.transfer(spark, source, target, glob="*.parquet")
    whole = copied.agg(F.sum("bytes")).first()[0]
    return spark.read.schema(spark.read.parquet(source).schema).parquet(target).where(F.lit(whole > 0))


@query("i_delegate_full", "SELECT event_id FROM events", "events")
def _(events):
    old = events.agg((F.max("ts") - F.expr("INTERVAL 90 DAYS")).alias("cursor"))
    return chosen(events, old)


@query("i_delegate_incremental", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) - INTERVAL 3 HOURS FROM events)", "events")
def _(events):
    recent = events.agg((F.max("ts") - F.expr("INTERVAL 3 HOURS")).alias("cursor"))
    return chosen(events, recent)


def chosen(events: DataFrame, state: DataFrame) -> DataFrame:
    newest = events.agg(F.max("ts")).first()[0]
    rows, _kind = delegating.delegated(state, "cursor", lambda: events, lambda cursor: events.where(F.col("ts") >= F.lit(cursor)), retention=timedelta(days=30), now=newest)
    return rows.select("event_id")


@query("k_chunks_hierarchy", r"SELECT doc_id, text FROM documents WHERE regexp_matches(text, '\S')", "documents")
def _(documents):
    chunks = chunking.hierarchy_chunks(documents, "text", 500, kind="markdown", keep=["doc_id"])
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "content"))), lambda c: c.content), "")  # a document's own chunks
    return chunks.groupBy("doc_id").agg(whole.alias("text"))


@query(
    "k_documents_nested",
    f"""WITH n AS ({PARTS}) SELECT 'shop_orders_' || o_orderkey || '_' || parts[1].v.n AS record_id, 'code: ["p","q"]' || chr(10) || 'tags: ["' || array_to_string(list_concat(parts[1].tags, parts[2].tags), '","') || '"]' AS content,
       CAST(parts[1].v.n AS VARCHAR) AS customer FROM n""",
    "orders",
)
def _(orders):
    names = {"body.parts.*.code": "code", "body.parts.*.tags.*": "tags", "body.**.n": "customer"}
    out = chunking.record_documents(nested(orders), ["body.parts.*.code", "body.parts.*.tags.*"], ["body.**.n"], "orders", ["o_orderkey", "body.parts.0.v.n"], "shop", names)
    return out.select("record_id", "content", F.col("metadata")["customer"].alias("customer"))


@query("i_state_formats", SESSIONS + """ SELECT user_id, start * 3600 AS start, "end" * 3600 AS "end" FROM m WHERE start IS NOT NULL""", "events")
def _(events):
    hours = merged(events).where("start is not null")
    at = lambda c: F.timestamp_seconds(F.col(c) * 3600).alias(c)
    rows = hours.select("user_id", at("start"), at("end"))
    for form in ("seconds", "iso", "%Y/%m/%d %H:%M"):
        rows = state_formats.intervals_of(state_formats.states_of(rows, ["user_id"], "ts", form), ["user_id"], "state", "ts", form)
    return rows.select("user_id", F.unix_seconds("start").alias("start"), F.unix_seconds("end").alias("end"))


@query("i_state_sequential", SESSIONS + """ SELECT user_id, min(start) * 3600 AS low FROM m WHERE start IS NOT NULL GROUP BY user_id""", "events")
def _(events):
    at = lambda c: F.timestamp_seconds(F.col(c) * 3600).alias(c)
    rows = merged(events).where("start is not null").select("user_id", at("start"), at("end"))
    held = state_formats.states_of(rows, ["user_id"], "ts", "millis", sequential=True)
    return held.select("user_id", (F.get_json_object("state", "$.ts").cast("long") / 1000).cast("long").alias("low"))


@query(
    "n_hash_nested",
    """SELECT o_orderkey, sha256('seed[(' || q || 'list' || q || ', ' || q || sha256('seed[' || q || sha256('seed' || o_orderstatus) || q || ', ' || q || sha256('seedNone') || q || ']') || q || '), (' || q || 'n' || q || ', ' || q || sha256('seed' || o_custkey) || q || ')]') AS hash FROM (SELECT *, chr(39) AS q FROM orders)""",
    "orders",
)
def _(orders):
    rows = orders.select("o_orderkey", F.struct(F.col("o_custkey").alias("n"), F.array("o_orderstatus", F.lit(None).cast("string")).alias("list")).alias("v"))
    return rows.select("o_orderkey", text.one_way_hash_of(F.col("v"), rows.schema["v"].dataType, "seed").alias("hash"))


@query(
    "s_file_errors",
    """SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) WHERE conv_id % 5 <> 0 OR r <= 2""",
    "conversations",
)
def _(conversations):
    spark = conversations.sparkSession
    # a file a conversation, of a line a turn; in every fifth the third line is broken, which costs the rest of that file alone
    line = F.to_json(F.struct("conv_id", "turn"))
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = conversations.withColumn("r", at).withColumn("line", F.when((F.col("conv_id") % 5 == 0) & (F.col("r") > 2), F.lit("{broken")).otherwise(line))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "line"))), lambda x: x.line), "\n")
    raw = rows.groupBy("conv_id").agg(F.encode(body, "utf-8").alias("content")).select(F.concat(F.col("conv_id").cast("string"), F.lit(".jsonl")).alias("path"), "content")
    parsed = files.parsed_files(raw, lambda content: (json.loads(x) for x in content.decode().splitlines()), "conv_id long, turn long", scratch.folder(spark, "parsed"))
    kinds = conversations.schema
    return files.records_of(parsed).select(*(F.col(c).cast(kinds[c].dataType).alias(c) for c in ("conv_id", "turn")))


@query(
    "f_conformance_nested",
    """SELECT event_id, (CASE WHEN value < 0 THEN 1 ELSE 0 END + CASE WHEN event_type IN ('purchase', 'click') THEN 0 ELSE 1 END + CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END)::INTEGER AS wrong FROM events WHERE value IS NOT NULL AND event_type IS NOT NULL""",
    "events",
)
def _(events):
    fields = {"amount": {"type": "number", "minimum": 0}, "kind": {"enum": ["purchase", "click"]}, "list": {"type": "array", "items": {"type": "object", "required": ["k"]}}}
    items = F.when(F.col("event_id") % 2 == 0, F.array(F.struct(F.lit(1).alias("k"), F.lit(1).alias("j")), F.struct(F.lit(None).cast("int").alias("k"), F.lit(2).alias("j"))))
    body = F.to_json(F.struct(F.struct(F.col("value").alias("amount"), F.col("event_type").alias("kind"), F.coalesce(items, F.array().cast("array<struct<k: int, j: int>>")).alias("list")).alias("inner")))
    rows = events.where("value is not null and event_type is not null").select("event_id", body.alias("body"))
    found = validation.validated(rows, "body", {"type": "object", "properties": {"inner": {"properties": fields}}})
    return found.select("event_id", F.size("violations").alias("wrong"))
