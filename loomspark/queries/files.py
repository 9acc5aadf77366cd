"""Sources and sinks on files that a query writes from the given tables into a folder of its own."""

from __future__ import annotations

import contextlib

from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from loomspark.plans import steps
from loomspark.queries import query, read
from loomspark.sources import commits, digests, lines, records, states
from loomspark.sources.folders import own_folder
from loomspark.streaming import events as streams

#: Events of a file.
PART = 3_000


def _in_parts(rows, text, kind):
    """One text file for every ``PART`` event ids, lines in their order; the path."""
    path = own_folder(rows.sparkSession, kind)
    part = F.lpad((F.col("event_id") / PART).cast("long").cast("string"), 12, "0").alias("part")
    dealt = rows.select(part, "event_id", text.alias("value")).repartition("part").sortWithinPartitions("part", "event_id")
    dealt.select("part", "value").write.partitionBy("part").text(path)
    return path


@query("SELECT event_id, user_id, event_type, value, row_number() OVER (ORDER BY event_id) AS ordinal FROM events ORDER BY event_id LIMIT 5000")
def json_lines_limit(spark, d):
    """The first 5,000 records of JSON-lines files in file order, blank lines between them."""
    events = read(spark, d, "events")
    line = F.to_json(F.struct("event_id", "user_id", "event_type", "value"))
    path = _in_parts(events, F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("\n"), line)).otherwise(line), "json-lines")
    schema = StructType([events.schema[c] for c in ("event_id", "user_id", "event_type", "value")])
    return lines.read_records(spark, path, schema, limit=5000, exact=True, least=1)


@query(
    """WITH e AS (SELECT event_id, event_id // 3000 AS part, event_id % 97 = 0 AS broken, event_id % 101 = 0 AND event_id % 97 > 0 AS odd,
  'r' || CAST(CASE WHEN event_id % 50 = 0 AND event_id >= 25 THEN event_id - 25 ELSE event_id END AS VARCHAR) AS key,
  CASE WHEN event_id % 40 = 0 THEN ['r' || CAST(event_id + 5 AS VARCHAR)] WHEN event_id % 4 = 0 THEN ['r' || CAST(event_id - 3 AS VARCHAR)] ELSE [] END AS links FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY event_id) + count_if(event_id % 7 = 0) OVER (PARTITION BY part ORDER BY event_id) AS line FROM e),
g AS (SELECT *, part * 1000000 + line AS place FROM n WHERE NOT broken AND NOT odd), f AS (SELECT key, min(place) AS first FROM g GROUP BY 1),
l AS (SELECT part, line, place, key AS own, unnest(links) AS key FROM g)
SELECT part, line, CASE WHEN odd THEN key END AS key, CASE WHEN broken THEN 'no record' ELSE 'unknown field' END AS fault FROM n WHERE broken OR odd
UNION ALL SELECT part, line, key, 'key exists' FROM g JOIN f USING (key) WHERE place > first
UNION ALL SELECT part, line, own, 'links to ' || key FROM l LEFT JOIN f USING (key) WHERE first IS NULL OR first >= place"""
)
def ledger_faults(spark, d):
    """Broken lines, repeated keys and links to keys that no earlier line has, by file and line."""
    i = F.col("event_id")
    key = F.concat(F.lit("r"), F.when((i % 50 == 0) & (i >= 25), i - 25).otherwise(i))
    link = F.when(i % 40 == 0, F.array(F.concat(F.lit("r"), i + 5))).when(i % 4 == 0, F.array(F.concat(F.lit("r"), i - 3))).otherwise(F.array().cast("array<string>"))
    good, odd = F.to_json(F.struct(key.alias("key"), link.alias("links"))), F.to_json(F.struct(key.alias("key"), link.alias("links"), F.lit(1).alias("more")))
    line = F.when(i % 97 == 0, F.lit('{"key": ')).when(i % 101 == 0, odd).otherwise(good)
    path = _in_parts(read(spark, d, "events"), F.when(i % 7 == 0, F.concat(F.lit("\n"), line)).otherwise(line), "ledger")
    schema = StructType().add("key", "string").add("links", ArrayType(StringType()))
    found = lines.ledger_faults(spark, path, schema, "key", "links")
    return found.select(F.regexp_extract("path", r"part=(\d+)", 1).cast("long").alias("part"), "line", "key", "fault")


@query("SELECT event_id, user_id, value, 3 AS commits FROM events")
def committed_events(spark, d):
    """Three appends by kinds of users, each tried twice; the second time it is refused and leaves nothing."""
    events = read(spark, d, "events").select("event_id", "user_id", "value")
    folder = own_folder(spark, "committed")
    for i in range(3):
        batch = events.filter(F.pmod(F.col("user_id"), F.lit(3)) == i)
        commits.append(batch, folder, ["event_id"])
        with contextlib.suppress(ValueError):
            commits.append(batch, folder, ["event_id"])
    n = len(commits.commits(spark, folder))
    return commits.read_committed(spark, folder, events.schema).withColumn("commits", F.lit(n))


@query(
    """SELECT event_id // 3000 AS part, CAST(sum(strlen(line)) AS BIGINT) AS length, sha256(string_agg(line, '' ORDER BY event_id)) AS sha256
FROM (SELECT event_id, event_id || ',' || event_type || ',' || user_id || chr(10) AS line FROM events) GROUP BY 1"""
)
def file_digests(spark, d):
    """Length and SHA-256 of the files that the events were written to."""
    path = _in_parts(read(spark, d, "events"), F.concat_ws(",", "event_id", "event_type", "user_id"), "digests")
    found = digests.file_digests(spark, path)
    return found.select(F.regexp_extract("path", r"part=(\d+)", 1).cast("long").alias("part"), "length", "sha256")


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_round_trip(spark, d):
    """A CSV file with a header, written and read again by a schema of another order."""
    rows = read(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    path = own_folder(spark, "csv")
    records.write_csv(rows, path)
    return records.read_csv(spark, path, StructType([rows.schema[c] for c in ("c_mktsegment", "c_acctbal", "c_custkey", "c_name", "c_nationkey")])).select(*rows.columns)


@query("SELECT l_orderkey, l_quantity, l_returnflag FROM lineitem WHERE l_returnflag = 'R'")
def parts_rewrite(spark, d):
    """Lines in folders of their return flag; of the folder and the columns that are wanted only these are read."""
    path = own_folder(spark, "parts")
    records.write_parts(read(spark, d, "lineitem"), path, ["l_returnflag"])
    return records.read_parts(spark, path, ["l_orderkey", "l_quantity", "l_returnflag"]).filter("l_returnflag = 'R'")


@query("SELECT c_custkey AS id, c_mktsegment AS kind, c_acctbal AS used FROM customer")
def csv_text_rows(spark, d):
    """Rows out of texts of CSV lines, a hundred customers to a text."""
    line = F.concat_ws(", ", "c_custkey", "c_mktsegment", F.col("c_acctbal").cast("string"))
    texts = read(spark, d, "customer").groupBy((F.col("c_custkey") / 100).cast("long")).agg(F.array_join(F.collect_list(line), "\n").alias("text"))
    return records.rows_from_csv_text(texts, "text", "id BIGINT, kind STRING, used DOUBLE")


@query("SELECT event_id, user_id, value FROM events")
def checked_union(spark, d):
    """Tables of each kind of event as one table whose keys are unique."""
    events = read(spark, d, "events").select("event_id", "user_id", "value", "event_type")
    early = F.col("event_type") < "m"
    return records.union_checked([events.filter(early).drop("event_type"), events.filter(~early).drop("event_type")], ["event_id"])


@query(
    """WITH e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
SELECT user_id AS thread, max(n) AS number, arg_max('{"event_id":' || event_id || ',"n":' || n || '}', n) AS state FROM e GROUP BY 1"""
)
def state_store(spark, d):
    """Each user's events as numbered states, appended in two commits; the last of each user."""
    rows = read(spark, d, "events").select("user_id", "event_id", F.expr("row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)").cast("long").alias("n"))
    rows = rows.select(F.col("user_id").alias("thread"), F.col("n").alias("number"), F.to_json(F.struct("event_id", "n")).alias("state"))
    folder = own_folder(spark, "states")
    states.append_states(rows.filter("number <= 3"), folder)
    states.append_states(rows.filter("number > 3"), folder)
    return states.latest_states(spark, folder).select("thread", "number", "state")


@query("SELECT event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value, (SELECT count(*) FROM events) AS logged FROM events GROUP BY 1")
def event_log(spark, d):
    """Events that stream into a log a few files at a time; the newest of each kind and the length of the log."""
    rows = read(spark, d, "events").select("event_id", "event_type", "value")
    folder = own_folder(spark, "log")
    rows.repartitionByRange(4, "event_id").write.parquet(f"{folder}/in")
    stream = streams.read_stream(spark, f"{folder}/in", rows.schema, 1)
    streams.append_log(stream, f"{folder}/log", f"{folder}/latest", "event_type", "event_id", f"{folder}/checkpoint").awaitTermination()
    logged = spark.read.parquet(f"{folder}/log").agg(F.count("*").alias("logged"))
    return streams.latest_state(spark, f"{folder}/latest", "event_type", "event_id").select("event_type", "event_id", "value").crossJoin(F.broadcast(logged))  # one row


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2, 3")
def windowed_counts(spark, d):
    """Events of each kind and hour."""
    rows = read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    found = streams.windowed_counts(rows, "ts", "event_type", "value", "1 hour", "2 hours")
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, run"""
)
def user_sessions(spark, d):
    """Runs of each user's events with pauses under six hours."""
    rows = read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    found = streams.sessions(rows, "ts", "user_id", "6 hours", "1 day")
    return found.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("SELECT c_nationkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def planned_totals(spark, d):
    """Two steps of a plan, each written and read again; the second run of the plan finds both done."""
    orders, customers = read(spark, d, "orders", "customer")
    joined = steps.Step("joined", ["orders", "customers"], lambda s, t: t["orders"].join(t["customers"], F.col("o_custkey") == F.col("c_custkey")).select("c_nationkey", "o_totalprice"))
    summed = steps.Step("summed", ["joined"], lambda s, t: t["joined"].groupBy("c_nationkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")))
    folder, given = own_folder(spark, "plan"), {"orders": orders, "customers": customers}
    steps.run(spark, [summed, joined], folder, given)
    return steps.run(spark, [summed, joined], folder, given)["summed"]
