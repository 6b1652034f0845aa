"""Queries of the event engine: the rows of ``events`` as production events (see ``production_events``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ironsieve.functions import severity as sev
from ironsieve.functions import text as tx
from ironsieve.functions.sourcemap import resolved
from ironsieve.operators import events as ev
from ironsieve.operators import rate_limits as limits
from ironsieve.operators.sourcemaps import resolve_frames
from ironsieve.plans.registry import Registry
from ironsieve.session import read_table
from ironsieve.streaming import errors as stream

query = Registry()

NAMES = ("TypeError", "ReferenceError", "SecurityError", "RangeError", "DbError")


def production_events(events: DataFrame) -> DataFrame:
    """Events as clients send them: errors have a name, message and stack made from the row's number k."""
    k = F.get_json_object("props", "$.k").cast("int")
    name = F.get(F.array(*[F.lit(n) for n in NAMES]), k % 5)
    message = F.concat(F.lit("v"), (k % 10).cast("string"), F.when(k % 2 == 0, " is undefined").otherwise(" is not defined"))
    head = F.concat(name, F.lit(": "), message, F.lit("\n"))
    inner = F.when(k % 11 == 0, F.lit("    at lib (node_modules/lib/index.js:1:1)\n")).otherwise("")
    own = F.concat(F.lit("    at handler"), (k % 7).cast("string"), F.lit(" (src/mod"), (k % 3).cast("string"), F.lit(".ts:"), (k % 20 + 1).cast("string"), F.lit(":5)"))
    kind = F.col("event_type")
    return events.select(
        F.col("event_id").alias("seq"),
        F.when(kind == "view", "performance").when(kind == "click", "api_error").otherwise(kind).alias("type"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
        F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")).alias("project_id"),
        F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"),
        F.when(
            kind == "error",
            F.struct(name.alias("name"), message.alias("message"), F.when(k % 13 != 0, F.concat(head, inner, own)).alias("stack"), F.lit(False).alias("handled")),
        ).alias("error"),
        F.concat(F.lit("/u/"), (k % 4).cast("string")).alias("url"),
        F.col("value").alias("value"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"),
    )


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return production_events(read_table(spark, sf_dir, "events"))


_EV = """WITH e0 AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
ev AS (SELECT event_id AS seq, CASE event_type WHEN 'view' THEN 'performance' WHEN 'click' THEN 'api_error' ELSE event_type END AS type,
 strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS timestamp, 'p' || user_id % 3 AS project_id, 's' || user_id AS session_id, '/u/' || k % 4 AS url, value, k, ts FROM e0),
er AS (SELECT *, CASE k % 5 WHEN 0 THEN 'TypeError' WHEN 1 THEN 'ReferenceError' WHEN 2 THEN 'SecurityError' WHEN 3 THEN 'RangeError' ELSE 'DbError' END AS name,
 'v' || k % 10 || CASE WHEN k % 2 = 0 THEN ' is undefined' ELSE ' is not defined' END AS message,
 CASE WHEN k % 13 = 0 THEN 'unknown' WHEN k % 11 = 0 THEN 'at lib (node_modules/lib/index.js:1:1)' ELSE 'at handler' || k % 7 || ' (src/mod' || k % 3 || '.ts:' || (k % 20 + 1) || ':5)' END AS frame,
 CASE WHEN k % 13 = 0 THEN 'unknown' ELSE 'handler' || k % 7 END AS fn, CASE WHEN k % 13 = 0 THEN 'unknown' ELSE 'src/mod' || k % 3 || '.ts' END AS own_file
 FROM ev WHERE type = 'error'),
gr AS (SELECT project_id, name, message, frame, count(*) AS occurrences, arg_min(timestamp, seq) AS first_seen, arg_max(timestamp, seq) AS last_seen, arg_min(fn, seq) AS fn, arg_min(own_file, seq) AS own_file FROM er GROUP BY ALL),
gs AS (SELECT *, left(sha256(project_id || '::' || name || '::' || message || '::' || frame), 16) AS id, name || ': ' || message AS title,
 CASE WHEN occurrences > 100 OR name = 'SecurityError' THEN 'critical' WHEN occurrences > 10 THEN 'high' WHEN occurrences > 1 OR name IN ('TypeError', 'ReferenceError') THEN 'medium' ELSE 'low' END AS severity,
 CASE frame WHEN 'unknown' THEN 'unknown' WHEN 'at lib (node_modules/lib/index.js:1:1)' THEN 'node_modules/lib/index.js' ELSE regexp_extract(frame, '\\((.+?):', 1) END AS file,
 CASE frame WHEN 'unknown' THEN 0 ELSE CAST(regexp_extract(frame, ':(\\d+):\\d+\\)', 1) AS INTEGER) END AS line FROM gr)"""


@query(f"{_EV} SELECT id, project_id, severity, title, file, line, occurrences, occurrences AS users_affected, first_seen, last_seen FROM gs")
def error_groups(spark, sf_dir):
    g = ev.group_errors(_events(spark, sf_dir))
    return g.select("id", "project_id", "severity", "title", "file", "line", "occurrences", "users_affected", "first_seen", "last_seen")


@query(f"{_EV} SELECT severity, count(*) AS n FROM gs GROUP BY 1")
def error_severity(spark, sf_dir):
    return ev.group_errors(_events(spark, sf_dir)).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_EV} SELECT id, severity, last_seen FROM gs WHERE severity = 'high' ORDER BY last_seen DESC, id")
def error_list(spark, sf_dir):
    return ev.list_errors(ev.group_errors(_events(spark, sf_dir)), "open", "high").select("id", "severity", "last_seen")


def _resolved(g: DataFrame) -> DataFrame:
    return ev.resolve(g, g.where("project_id = 'p1'").select("id"))


@query(f"{_EV} SELECT id, CASE project_id WHEN 'p1' THEN 'resolved' ELSE 'recurring' END AS status, last_seen AS last_occurrence, round(date_diff('microsecond', CAST(replace(replace(last_seen, 'T', ' '), 'Z', '') AS TIMESTAMP), TIMESTAMP '2024-02-01') / 3600000000.0, 6) AS hours_since_last, round(CASE project_id WHEN 'p1' THEN least(date_diff('microsecond', CAST(replace(replace(last_seen, 'T', ' '), 'Z', '') AS TIMESTAMP), TIMESTAMP '2024-02-01') / 3600000000.0 / 24, 1.0) ELSE least(occurrences / 10.0, 1.0) END, 6) AS confidence FROM gs")
def error_status(spark, sf_dir):
    g = _resolved(ev.group_errors(_events(spark, sf_dir)))
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    return ev.error_status(g, now).withColumns({c: F.round(c, 6) for c in ("hours_since_last", "confidence")})


@query(f"""{_EV} SELECT id, CASE name WHEN 'DbError' THEN 'DbError' ELSE 'A ' || name END || ' occurred ' || CASE fn WHEN 'unknown' THEN 'at an unknown location' ELSE 'in ' || fn || ' (' || own_file || ')' END || ': ' || message || '.' ||
 CASE name WHEN 'TypeError' THEN ' This typically indicates an operation on an undefined or null value.' WHEN 'ReferenceError' THEN ' A variable or function was used before being defined.' WHEN 'SecurityError' THEN ' A security policy was violated.' WHEN 'RangeError' THEN ' A value is outside the allowed range.' ELSE '' END AS root_cause FROM gs""")
def root_cause(spark, sf_dir):
    return ev.group_errors(_events(spark, sf_dir)).select("id", "root_cause")


_ADVICE = [a[2] for a in tx.ADVICE]
_FIXES = (
    "CASE name WHEN 'TypeError' THEN CASE WHEN contains(message, 'undefined') THEN '{0}' ELSE '{2}' END "
    "WHEN 'ReferenceError' THEN CASE WHEN contains(message, 'is not defined') THEN 'Ensure ' || regexp_extract(message, '(\\w+) is not defined', 1) || ' is defined and imported before use. Check for typos in the variable name and verify the import path is correct.' ELSE '{4}' END "
    "WHEN 'SecurityError' THEN '{7}' WHEN 'RangeError' THEN '{6}' ELSE 'Investigate the ' || name || ' error. Check the stack trace for the originating function and add appropriate error handling.' END"
).format(*_ADVICE)


@query(f"{_EV} SELECT id, {_FIXES} AS suggested_fix FROM gs")
def suggested_fixes(spark, sf_dir):
    return ev.group_errors(_events(spark, sf_dir)).select("id", "suggested_fix")


@query(f"{_EV} SELECT seq, frame FROM er")
def first_frame(spark, sf_dir):
    e = _events(spark, sf_dir).where("type = 'error'")
    return e.select("seq", tx.first_frame(F.col("error.stack")).alias("frame"))


@query(f"{_EV} SELECT count(*) AS accepted, count(*) FILTER (type IN ('error', 'performance', 'api_error')) AS processed FROM ev")
def ingest_counts(spark, sf_dir):
    return ev.ingest_counts(_events(spark, sf_dir))


@query(f"{_EV} SELECT seq, timestamp, value FROM ev WHERE type = 'performance' ORDER BY timestamp DESC, seq LIMIT 100")
def latest_metrics(spark, sf_dir):
    m = ev.route(_events(spark, sf_dir))["performance"]
    return ev.newest(m.select("seq", "timestamp", "value"), 100, tie="seq")


@query(f"{_EV} SELECT seq, timestamp, url FROM ev WHERE type = 'api_error' AND url = '/u/1'")
def api_errors_by_path(spark, sf_dir):
    return ev.route(_events(spark, sf_dir))["api_error"].where("url = '/u/1'").select("seq", "timestamp", "url")


@query(f"{_EV} SELECT type, count(*) AS n FROM ev WHERE type IN ('error', 'performance', 'api_error') GROUP BY 1")
def event_router(spark, sf_dir):
    parts = ev.route(_events(spark, sf_dir))
    one, two, three = (p.groupBy("type").agg(F.count(F.lit(1)).alias("n")) for p in parts.values())
    return one.unionAll(two).unionAll(three)


@query(f"""{_EV}, h AS (SELECT project_id, name, message, frame, count(*) FILTER (k % 2 = 0) AS a, count(*) FILTER (k % 2 = 1) AS b, arg_min(timestamp, seq) AS first_seen, arg_max(timestamp, seq) AS last_seen FROM er GROUP BY ALL)
SELECT left(sha256(project_id || '::' || name || '::' || message || '::' || frame), 16) AS id, CASE WHEN b > 0 THEN b ELSE a END AS occurrences, first_seen, last_seen FROM h""")
def error_upsert(spark, sf_dir):
    e = _events(spark, sf_dir)
    k = F.substring("error.message", 2, 1).cast("int")
    return ev.upsert(ev.group_errors(e.where(k % 2 == 0)), ev.group_errors(e.where(k % 2 == 1))).select("id", "occurrences", "first_seen", "last_seen")


@query(f"{_EV}, n AS (SELECT session_id, seq, (row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1) // 10 AS batch FROM ev) SELECT session_id, batch, min(seq) AS first_seq, count(*) AS n FROM n GROUP BY 1, 2")
def client_batches(spark, sf_dir):
    return ev.client_batches(_events(spark, sf_dir))


_SHARE = "CAST('0x' || left(md5(CAST(seq AS VARCHAR)), 8) AS BIGINT) / 4294967296.0"


@query(f"{_EV} SELECT seq, type FROM ev WHERE {_SHARE} < CASE type WHEN 'performance' THEN 0.1 ELSE 0.5 END")
def sampled_events(spark, sf_dir):
    return ev.sampled(_events(spark, sf_dir), 0.5, special=0.1).select("seq", "type")


_LIMITS = """, rq AS (SELECT project_id, epoch_us(ts) // 1000 AS at_ms, seq FROM ev), st(project_id, s) AS (SELECT project_id, min(at_ms) FROM rq GROUP BY 1 UNION ALL
 SELECT project_id, s FROM (SELECT st.project_id, min(rq.at_ms) AS s FROM st JOIN rq ON rq.project_id = st.project_id AND rq.at_ms >= st.s + 3600000 GROUP BY 1)),
 w AS (SELECT rq.project_id, at_ms, seq, s, row_number() OVER (PARTITION BY rq.project_id, s ORDER BY at_ms, seq) AS n FROM rq ASOF JOIN st ON rq.project_id = st.project_id AND rq.at_ms >= st.s)"""
_LIMITED = f"{_EV.replace('WITH e0', 'WITH RECURSIVE e0', 1)}{_LIMITS}"


@query(f"{_LIMITED} SELECT project_id, at_ms, seq, n <= 10 AS allowed, greatest(0, 10 - n) AS remaining, s + 3600000 AS reset_ms FROM w")
def rate_limit(spark, sf_dir):
    """Requests of each project against ten in an hour, in windows that start with their first request."""
    r = _events(spark, sf_dir).select("project_id", "at_ms", "seq")
    return limits.rate_limited(r, 10, 3_600_000)


@query(f"{_LIMITED} SELECT project_id, at_ms, n <= 10 AS allowed, greatest(0, 10 - n) AS remaining, s + 3600000 AS reset_ms FROM w")
def streaming_rate_limit(spark, sf_dir):
    """The same limits over a stream."""
    return stream.limit_once(spark, sf_dir, lambda e: production_events(e).select("project_id", "at_ms", "seq"), 10, 3_600_000)


@query(f"{_LIMITED} SELECT seq, n <= CASE WHEN seq % 3 = 0 THEN 5 ELSE 10 END AS allowed FROM w")
def shared_rate_limit(spark, sf_dir):
    """Two routes with limits of their own share a project's counter."""
    r = _events(spark, sf_dir).select("project_id", "at_ms", "seq", F.when(F.col("seq") % 3 == 0, 5).otherwise(10).alias("most"))
    return limits.rate_limited(r, window_ms=3_600_000).select("seq", "allowed")


_TICKS = "t AS (SELECT session_id, seq, (epoch_us(ts) // 1000 - min(epoch_us(ts) // 1000) OVER (PARTITION BY session_id)) // 3600000 AS tick FROM ev), p AS (SELECT *, (row_number() OVER (PARTITION BY session_id, tick ORDER BY seq) - 1) // 10 AS part FROM t), b AS (SELECT session_id, tick, part, min(seq) AS first_seq, count(*) AS n FROM p GROUP BY 1, 2, 3)"


@query(f"{_EV}, {_TICKS} SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY tick, part) - 1 AS batch, first_seq, n FROM b")
def client_batches_timed(spark, sf_dir):
    """Batches of ten events, and of what is in the queue every hour."""
    return ev.client_batches(_events(spark, sf_dir), flush_ms=3_600_000)


_OPEN = "o AS (SELECT b.*, row_number() OVER (PARTITION BY session_id ORDER BY tick, part) - 1 AS batch, min(first) OVER (PARTITION BY session_id) + (tick + 1) * 3600000 AS tick_end FROM b JOIN (SELECT session_id, min(epoch_us(ts) // 1000) AS first FROM ev GROUP BY 1) USING (session_id))"


@query(f"{_EV}, {_TICKS}, {_OPEN} SELECT session_id, batch, first_seq, n FROM o WHERE n = 10 OR tick_end <= (SELECT max(epoch_us(ts) // 1000) FROM ev)")
def streaming_client_batches(spark, sf_dir):
    """The timed batches over a stream, with timers; what is still queued when the events end isn't sent."""
    return stream.batches_once(spark, sf_dir, lambda e: production_events(e).select("session_id", "at_ms", "seq"), 3_600_000)


@query(f"{_EV} SELECT seq, CASE url WHEN '/u/1' THEN '[path]' ELSE url END AS url FROM ev WHERE url <> '/u/0'")
def sent_events(spark, sf_dir):
    """What a client's hook leaves: one address is dropped, one is masked."""
    hook = lambda e: e.where("url != '/u/0'").withColumn("url", F.when(F.col("url") == "/u/1", "[path]").otherwise(F.col("url")))
    return ev.before_send(_events(spark, sf_dir), hook).select("seq", "url")


@query(f"{_EV} SELECT seq, 'src/b.ts' AS file, CASE seq % 3 WHEN 1 THEN 5 ELSE CAST(seq % 3 + 1 AS INTEGER) END AS line FROM ev WHERE type = 'error'")
def source_map_positions(spark, sf_dir):
    """Positions by a map's segments where there are any for the line, else the line itself in the first own source."""
    content = '{"version":3,"sources":["node_modules/a.js","src/b.ts"],"mappings":";ACIA,IAAA"}'
    e = _events(spark, sf_dir).where("type = 'error'").select("seq", (F.col("seq") % 3 + 1).cast("int").alias("line"))
    return e.select("seq", resolved(F.lit(content), F.col("line"), F.lit(0)).alias("r")).select("seq", F.col("r.source").alias("file"), F.col("r.line").cast("int").alias("line"))


_MAP = '{"version":3,"sources":["node_modules/a.js","../src/b.ts"],"names":["f"],"mappings":"AAAA,UCIGA;IAIH,M;;"}'
_HIT = "k % 3 < 2 AND (k % 5 = 0 AND k % 17 >= 10 OR k % 5 = 1 AND k % 17 BETWEEN 4 AND 9)"


@query(f"""{_EV} SELECT seq, CASE k % 3 WHEN 2 THEN 'dist/mod2.js' ELSE 'src/b.ts' END AS source_file, CAST(CASE WHEN {_HIT} THEN CASE k % 5 WHEN 0 THEN 5 ELSE 9 END ELSE k % 5 + 1 END AS INTEGER) AS source_line,
 CAST(CASE WHEN {_HIT} THEN CASE k % 5 WHEN 0 THEN 3 ELSE 0 END END AS INTEGER) AS source_column, CASE WHEN {_HIT} AND k % 5 = 0 THEN 'f' END AS source_name FROM ev""")
def source_map_frames(spark, sf_dir):
    """Every event as a frame of one of three generated files: one has a map, one is listed under its own name, one has none."""
    e = read_table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    frames = e.select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")).alias("project_id"),
        F.lit("r1").alias("release"),
        F.concat(F.lit("dist/mod"), (k % 3).cast("string"), F.lit(".js")).alias("file"),
        (k % 5 + 1).alias("line"),
        (k % 17).alias("column"),
    )
    paths = F.explode(F.array(F.lit("dist/mod0.js.map"), F.lit("dist/mod1.js")))
    maps = frames.select("project_id", "release").distinct().select("*", paths.alias("file_path"), F.lit(_MAP).alias("content"))
    return resolve_frames(frames, maps).select("seq", "source_file", "source_line", "source_column", "source_name")


@query(f"{_EV} SELECT id, CASE WHEN project_id = 'p2' THEN NULL WHEN file LIKE 'src/mod%' THEN replace(file, '.ts', '.orig.ts') ELSE file END AS source FROM gs WHERE project_id <> 'p0'")
def new_group_sources(spark, sf_dir):
    """Groups that are new: those with a release get their file's source, groups of p2 have none, those of p0 are stored."""
    g = ev.group_errors(_events(spark, sf_dir)).withColumn("release", F.when(F.col("project_id") != "p2", "r1"))
    names = g.where("file like 'src/mod%'").select("project_id", "file").distinct()
    content = F.concat(F.lit('{"sources":["node_modules/x.js","'), F.regexp_replace("file", r"\.ts$", ".orig.ts"), F.lit('"]}'))
    maps = names.select("project_id", F.lit("r1").alias("release"), F.concat("file", F.lit(".map")).alias("file_path"), content.alias("content"))
    return ev.enrich_new(g, g.where("project_id = 'p0'"), maps).select("id", "source")


@query(f"{_EV} SELECT seq, 'src' || k % 3 || '/orig.ts' AS source FROM er WHERE k % 13 <> 0 AND k % 11 <> 0")
def source_map_lookup(spark, sf_dir):
    e = _events(spark, sf_dir).where("type = 'error'")
    place = tx.file_and_line(F.col("error.stack"))
    errors = e.select("seq", "project_id", F.lit("r1").alias("release"), place["file"].alias("file")).where(F.startswith("file", F.lit("src/")))
    content = F.concat(F.lit('{"sources":["node_modules/x.js","src'), "m", F.lit('/orig.ts"]}'))
    projects = e.select("project_id").distinct().withColumn("m", F.explode(F.array(*map(F.lit, "012"))))
    maps = projects.select("project_id", F.lit("r1").alias("release"), F.concat(F.lit("src/mod"), "m", F.lit(".ts.map")).alias("file_path"), content.alias("content"))
    return ev.resolved_frames(errors, maps).select("seq", "source")


@query(f"{_EV}, u AS (SELECT project_id, url, arg_max(value, seq) AS value, arg_min(timestamp, seq) AS uploaded_at FROM ev GROUP BY 1, 2) SELECT * FROM u")
def source_map_upsert(spark, sf_dir):
    e = _events(spark, sf_dir).select("project_id", "url", "value", F.col("timestamp").alias("uploaded_at"), "seq")
    return ev.latest_wins(e, ["project_id", "url"], "seq", ["uploaded_at"]).drop("seq")


@query("SELECT o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 3 END AS rank FROM orders WHERE o_orderstatus = 'O' ORDER BY rank, o_orderdate DESC, id")
def orders_by_severity(spark, sf_dir):
    p = F.col("o_orderpriority")
    rank = sev.lookup(p, {"1-URGENT": 0, "2-HIGH": 1, "3-MEDIUM": 2}, 3)
    o = read_table(spark, sf_dir, "orders").where("o_orderstatus = 'O'")
    return o.select(F.col("o_orderkey").alias("id"), rank.alias("rank"), "o_orderdate").orderBy("rank", F.desc("o_orderdate"), "id").select("id", "rank")


@query("SELECT o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 3 END AS rank FROM orders WHERE o_orderstatus = 'O' ORDER BY rank, o_orderdate DESC, id")
def all_orders_by_severity(spark, sf_dir):
    """As orders_by_severity, which once stopped after 500."""
    rank = sev.lookup(F.col("o_orderpriority"), {"1-URGENT": 0, "2-HIGH": 1, "3-MEDIUM": 2}, 3)
    o = read_table(spark, sf_dir, "orders").where("o_orderstatus = 'O'")
    return o.select(F.col("o_orderkey").alias("id"), rank.alias("rank"), "o_orderdate").orderBy("rank", F.desc("o_orderdate"), "id").select("id", "rank")


@query("SELECT 'p' || user_id % 3 AS project_id, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_rollup(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    return e.groupBy(F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")).alias("project_id"), "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")
    )


@query(f"{_EV}, m AS (SELECT project_id, name, message, frame, max(seq) AS last_seq FROM er GROUP BY ALL) SELECT id, CASE project_id WHEN 'p1' THEN 'resolved' ELSE 'open' END AS status, CASE project_id WHEN 'p1' THEN last_seq > 500 END AS recurred FROM gs JOIN m USING (project_id, name, message, frame)")
def streaming_resolved_groups(spark, sf_dir):
    """Groups that were resolved stay so when they recur, and say whether they did."""
    told = lambda g: g.where("project_id = 'p1'").select("id", F.lit(500).cast("long").alias("at_seq"))
    return stream.run_once(spark, sf_dir, production_events, told).select("id", "status", "recurred")


@query(f"{_EV} SELECT id, severity, occurrences, first_seen, last_seen FROM gs")
def streaming_error_groups(spark, sf_dir):
    """Groups kept by a stream over the same events; its final state equals the batch result."""
    return stream.run_once(spark, sf_dir, production_events).select("id", "severity", "occurrences", "first_seen", "last_seen")


@query(f"{_EV} SELECT type, count(*) AS n FROM ev WHERE type IN ('error', 'performance', 'api_error') GROUP BY 1")
def streaming_router(spark, sf_dir):
    return stream.route_once(spark, sf_dir, production_events).groupBy("type").agg(F.count(F.lit(1)).alias("n"))
