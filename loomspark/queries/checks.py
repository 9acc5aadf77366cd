"""Gates, validation, splits, lineage and the ledger."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomspark.operators import gates, joins, ledger, splits
from loomspark.queries import query, read

THRESHOLDS = {"price": 1200.0, "size": 10.0, "name": 12.0, "type": 14.0}


def _part_scores(spark, d):
    parts = read(spark, d, "part")
    scores = F.array(
        F.struct(F.lit("price").alias("gate"), F.col("p_retailprice").alias("score")),
        F.struct(F.lit("size").alias("gate"), F.when(F.col("p_size") % 7 != 0, F.col("p_size").cast("double")).alias("score")),
        F.struct(F.lit("name").alias("gate"), F.length("p_name").cast("double").alias("score")),
        F.struct(F.when(F.col("p_size") % 5 != 0, "type").otherwise("other").alias("gate"), F.length("p_type").cast("double").alias("score")),
    )
    return parts.select("p_partkey", F.explode(scores).alias("s")).select("p_partkey", "s.gate", "s.score")


PART_SCORES = """
WITH m AS (
  SELECT p_partkey, p_retailprice - 1200 AS price, CASE WHEN p_size % 7 <> 0 THEN p_size - 10.0 END AS size,
         length(p_name) - 12.0 AS name, CASE WHEN p_size % 5 <> 0 THEN length(p_type) - 14.0 END AS type FROM part
)"""


@query(
    PART_SCORES
    + """
SELECT p_partkey, list_filter([CASE WHEN coalesce(name >= 0, false) THEN NULL ELSE 'name' END, CASE WHEN coalesce(price >= 0, false) THEN NULL ELSE 'price' END,
         CASE WHEN coalesce(size >= 0, false) THEN NULL ELSE 'size' END, CASE WHEN coalesce(type >= 0, false) THEN NULL ELSE 'type' END], lambda x: x IS NOT NULL) AS failed_gates,
       CAST(coalesce(name >= 0, false) AS BIGINT) + CAST(coalesce(price >= 0, false) AS BIGINT) + CAST(coalesce(size >= 0, false) AS BIGINT) + CAST(coalesce(type >= 0, false) AS BIGINT) AS pass_count
FROM m"""
)
def gate_failed_list(spark, d):
    return gates.gate_report(_part_scores(spark, d), ["p_partkey"], "gate", "score", THRESHOLDS).drop("worst_margin")


@query(PART_SCORES + " SELECT p_partkey, round(least(coalesce(name, -1), coalesce(price, -1), coalesce(size, -1), coalesce(type, -1)), 4) AS worst_margin FROM m")
def gate_worst_margin(spark, d):
    found = gates.gate_report(_part_scores(spark, d), ["p_partkey"], "gate", "score", THRESHOLDS)
    return found.select("p_partkey", F.round("worst_margin", 4).alias("worst_margin"))


LINES = """
WITH l AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity / 50 AS quantity, 1 - l_discount * 10 AS discount, 1 - l_tax * 10 AS tax,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) AS n
  FROM lineitem
)"""


def _lines(spark, d):
    lines = read(spark, d, "lineitem")
    place = F.expr("row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice)")
    return lines.select(
        "l_orderkey",
        (F.col("l_quantity") / 50).alias("quantity"),
        (1 - F.col("l_discount") * 10).alias("discount"),
        (1 - F.col("l_tax") * 10).alias("tax"),
        place.cast("long").alias("n"),
    )


@query(
    LINES
    + """, j AS (SELECT l.*, b.quantity AS bq, b.discount AS bd, b.tax AS bt FROM l JOIN l b ON l.l_orderkey = b.l_orderkey AND b.n = 1),
k AS (SELECT *, greatest(0, 0.2 - quantity) + greatest(0, 0.3 - discount) AS s,
        greatest(0, bq - quantity - 0.05) + greatest(0, bd - discount - 0.05) + greatest(0, bt - tax - 0.05) AS e,
        0.5 * quantity + 0.3 * discount + 0.2 * tax - 0.01 * n AS u FROM j)
SELECT l_orderkey, n, round(s, 4) AS shortfall, round(e, 4) AS excess, round(u, 4) AS utility, round(u - s - e, 4) AS penalised, s <= 1e-12 AND e <= 1e-12 AS accepted FROM k"""
)
def utility_penalised(spark, d):
    lines = _lines(spark, d)
    found = gates.assess_against_baseline(
        lines,
        F.col("n") == 1,
        ["l_orderkey"],
        {"quantity": 0.5, "discount": 0.3, "tax": 0.2},
        {"quantity": 0.2, "discount": 0.3},
        0.05,
        F.lit(0.01) * F.col("n"),
    )
    return found.select("l_orderkey", "n", *(F.round(c, 4).alias(c) for c in ("shortfall", "excess", "utility", "penalised")), "accepted")


@query(
    LINES
    + """, j AS (SELECT l.l_orderkey, count(*) AS candidates,
  count_if(l.quantity >= b.quantity - 0.1 AND l.discount >= b.discount - 0.1 AND l.tax >= b.tax - 0.1) AS not_worse
  FROM l JOIN l b ON l.l_orderkey = b.l_orderkey AND b.n = 1 WHERE l.n > 1 GROUP BY ALL)
SELECT l_orderkey, candidates, CAST(not_worse AS BIGINT) AS not_worse, not_worse = candidates AS all_hold FROM j"""
)
def non_regression(spark, d):
    lines = _lines(spark, d)
    metrics = ("quantity", "discount", "tax")
    held = lines.withColumns({f"b_{c}": F.first(c).over(Window.partitionBy("l_orderkey").orderBy("n")) for c in metrics})
    ok = F.lit(True)
    for c in metrics:
        ok = ok & (F.col(c) >= F.col(f"b_{c}") - 0.1)
    found = held.filter("n > 1").groupBy("l_orderkey").agg(F.count("*").alias("candidates"), F.count_if(ok).alias("not_worse"))
    return found.withColumn("all_hold", F.col("not_worse") == F.col("candidates"))


@query(
    """SELECT d.doc_id, n_chars >= 300 AND (l.quality IS NULL OR l.quality = 1) AS shown, n_chars >= 300 AND l.quality IS NOT NULL AND l.quality = 1 AS promoted,
       round(CASE WHEN l.quality IS NULL THEN least(n_chars / 1000.0 - 0.3, -0.5) WHEN l.quality = 0 THEN least(n_chars / 1000.0 - 0.3, -1) ELSE n_chars / 1000.0 - 0.3 END, 4) AS margin
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""
)
def review_tristate(spark, d):
    docs, labels = read(spark, d, "documents", "labels")
    human = F.col("quality") == 1
    shown, promoted = gates.review_state(F.col("n_chars") >= 300, human)
    margin = gates.capped_margin([F.col("n_chars") / 1000.0 - 0.3], human)
    return docs.join(labels, "doc_id", "left").select("doc_id", shown.alias("shown"), promoted.alias("promoted"), F.round(margin, 4).alias("margin"))


@query(
    """SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'unavailable' WHEN n_regionkey = 0 THEN 'missing_required_capability'
  WHEN s_nationkey % 3 = 1 THEN 'quality_tier_too_low' WHEN s_acctbal > 8000 THEN 'latency_budget_exceeded' END AS reason
FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey"""
)
def route_reject_reason(spark, d):
    suppliers, nations = read(spark, d, "supplier", "nation")
    reason = gates.first_reason(
        [
            (F.col("s_acctbal") < 0, "unavailable"),
            (F.col("n_regionkey") == 0, "missing_required_capability"),
            (F.col("s_nationkey") % 3 == 1, "quality_tier_too_low"),
            (F.col("s_acctbal") > 8000, "latency_budget_exceeded"),
        ]
    )
    return suppliers.join(nations, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", reason.alias("reason"))


@query(
    """SELECT p_partkey, list_filter([CASE WHEN p_size BETWEEN 1 AND 40 THEN NULL ELSE 'size' END, CASE WHEN p_retailprice >= 950 THEN NULL ELSE 'price' END,
  CASE WHEN regexp_full_match(p_brand, 'Brand#[1-4][0-9]*') THEN NULL ELSE 'brand' END], lambda x: x IS NOT NULL) AS broken FROM part
WHERE NOT (p_size BETWEEN 1 AND 40 AND p_retailprice >= 950 AND regexp_full_match(p_brand, 'Brand#[1-4][0-9]*'))"""
)
def row_rules(spark, d):
    rules = {"size": F.col("p_size").between(1, 40), "price": F.col("p_retailprice") >= 950, "brand": F.col("p_brand").rlike("^Brand#[1-4][0-9]*$")}
    return gates.violations(read(spark, d, "part"), rules).select("p_partkey", "broken")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def repeated_keys(spark, d):
    return gates.repeated_keys(read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    """WITH a AS (SELECT c_nationkey AS k, CAST(count(*) AS VARCHAR) AS n, max(c_mktsegment) AS seg FROM customer GROUP BY 1),
b AS (SELECT s_nationkey AS k, CAST(count(*) * 10 AS VARCHAR) AS n, 'MACHINERY' AS seg FROM supplier GROUP BY 1),
x AS (SELECT k, 'n' AS field, n AS value FROM a UNION ALL SELECT k, 'seg', seg FROM a), y AS (SELECT k, 'n' AS field, n AS value FROM b UNION ALL SELECT k, 'seg', seg FROM b)
SELECT coalesce(x.k, y.k) AS k, coalesce(x.field, y.field) AS field, x.value AS "left", y.value AS "right" FROM x FULL JOIN y ON x.k = y.k AND x.field = y.field
WHERE x.value IS DISTINCT FROM y.value"""
)
def field_mismatch(spark, d):
    customers, suppliers = read(spark, d, "customer", "supplier")
    a = customers.groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n"), F.max("c_mktsegment").alias("seg"))
    b = suppliers.groupBy(F.col("s_nationkey").alias("k")).agg((F.count("*") * 10).alias("n"), F.lit("MACHINERY").alias("seg"))
    return gates.difference(a, b, ["k"], ["n", "seg"])


SPLIT = """
WITH k AS (SELECT *, CAST(('0x' || substr(sha256('7:' || o_orderpriority || ':' || CAST(o_custkey % 97 AS VARCHAR)), 1, 16))::UBIGINT AS DOUBLE) / 18446744073709551616.0 AS u FROM orders),
s AS (SELECT *, CASE WHEN u < 0.1 THEN 'test' WHEN u < 0.25 THEN 'validation' ELSE 'train' END AS split FROM k)
"""


@query(SPLIT + "SELECT o_orderkey, split FROM s")
def split_hash(spark, d):
    group = F.concat_ws(":", "o_orderpriority", (F.col("o_custkey") % 97).cast("string"))
    return read(spark, d, "orders").select("o_orderkey", splits.hash_split(group, 7, 0.15, 0.1).alias("split"))


@query(SPLIT + "SELECT o_custkey, list_sort(list(DISTINCT split)) AS splits FROM s GROUP BY 1 HAVING count(DISTINCT split) > 1")
def split_leakage(spark, d):
    group = F.concat_ws(":", "o_orderpriority", (F.col("o_custkey") % 97).cast("string"))
    rows = read(spark, d, "orders").select("o_custkey", splits.hash_split(group, 7, 0.15, 0.1).alias("split"))
    return splits.leaks(rows, "o_custkey", "split")


@query(
    """WITH k AS (SELECT *, CAST(('0x' || substr(sha256('3:' || source), 1, 16))::UBIGINT AS DOUBLE) / 18446744073709551616.0 AS u FROM documents)
SELECT CASE WHEN u < 0.2 THEN 'test' WHEN u < 0.4 THEN 'validation' ELSE 'train' END AS split, count(*) AS n, count(DISTINCT source) AS n_source, count(DISTINCT lang) AS n_lang FROM k GROUP BY 1"""
)
def curriculum_diversity(spark, d):
    rows = read(spark, d, "documents").withColumn("split", splits.hash_split(F.col("source"), 3, 0.2, 0.2))
    return splits.diversity(rows, "split", ["source", "lang"])


@query("WITH g AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) SELECT c_nationkey, n AS test_rows, CAST((SELECT sum(n) FROM g) - n AS BIGINT) AS train_rows FROM g")
def leave_one_group_out(spark, d):
    return splits.leave_one_out(read(spark, d, "customer"), "c_nationkey")


@query(
    """SELECT sha256(text) AS content_sha256, count(*) AS n, min(doc_id) AS first_key, max(doc_id) AS last_key FROM documents
GROUP BY text HAVING count(*) > 1 AND NOT bool_and(lang = 'en')"""
)
def duplicate_content(spark, d):
    return splits.repeated_content(read(spark, d, "documents"), F.col("text"), "doc_id", F.col("lang") == "en")


@query(
    """SELECT l_orderkey, list_filter([CASE WHEN count_if(l_returnflag = 'A') = 0 THEN 'A' END, CASE WHEN count_if(l_returnflag = 'N') = 0 THEN 'N' END, CASE WHEN count_if(l_returnflag = 'R') = 0 THEN 'R' END], lambda x: x IS NOT NULL) AS missing,
  list_filter([CASE WHEN count_if(l_returnflag = 'A') > 1 THEN 'A' END, CASE WHEN count_if(l_returnflag = 'N') > 1 THEN 'N' END, CASE WHEN count_if(l_returnflag = 'R') > 1 THEN 'R' END], lambda x: x IS NOT NULL) AS repeated
FROM lineitem GROUP BY 1 HAVING NOT (count_if(l_returnflag = 'A') = 1 AND count_if(l_returnflag = 'N') = 1 AND count_if(l_returnflag = 'R') = 1)"""
)
def coverage_cells(spark, d):
    return splits.cells_missing(read(spark, d, "lineitem"), "l_orderkey", "l_returnflag", ["A", "N", "R"])


@query("SELECT c_custkey, n_name, n_regionkey, n_nationkey IS NOT NULL AS has_lineage FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 4) ON c_nationkey = n_nationkey")
def lineage_attach(spark, d):
    customers, nations = read(spark, d, "customer", "nation")
    lineage = nations.filter("n_regionkey <> 4").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey")
    return joins.attach_lineage(customers, lineage, ["c_nationkey"]).select("c_custkey", "n_name", "n_regionkey", "has_lineage")


@query(
    """SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_partkey IS NOT NULL)
AND p_partkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_suppkey IS NOT NULL)"""
)
def fk_kind_antijoin(spark, d):
    parts, lines = read(spark, d, "part", "lineitem")
    return joins.unreferenced(parts, "p_partkey", (lines.filter("l_returnflag = 'R'"), "l_partkey"), (lines, "l_suppkey")).select("p_partkey")


@query(
    """SELECT state, count(*) AS n FROM (SELECT CASE WHEN p_partkey IS NULL THEN 'missing' WHEN p_size <= 25 THEN 'ok' ELSE 'wrong_kind' END AS state
FROM lineitem LEFT JOIN part ON l_partkey + 50 = p_partkey) GROUP BY 1"""
)
def foreign_key_states(spark, d):
    parts, lines = read(spark, d, "part", "lineitem")
    found = joins.foreign_key_report(lines.select((F.col("l_partkey") + 50).alias("wanted")), parts, "wanted", "p_partkey", F.col("p_size") <= 25)
    return found.groupBy("state").agg(F.count("*").alias("n"))


@query(
    """WITH r AS (SELECT c_custkey, c_mktsegment, c_nationkey % 3 AS grp FROM customer)
SELECT a.c_custkey, coalesce((SELECT min(b.c_custkey) FROM r b WHERE b.c_mktsegment = a.c_mktsegment AND b.grp <> a.grp AND b.c_custkey > a.c_custkey),
  (SELECT min(b.c_custkey) FROM r b WHERE b.c_mktsegment = a.c_mktsegment AND b.grp <> a.grp)) AS donor FROM r a"""
)
def donor_cross_group(spark, d):
    rows = read(spark, d, "customer").withColumn("grp", F.col("c_nationkey") % 3)
    return joins.next_of_another_group(rows, ["c_mktsegment"], "c_custkey", "grp").select("c_custkey", "donor")


RECORDS = """
WITH o AS (SELECT *, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next_key FROM orders),
a AS (SELECT *, next_key IS NULL AS alive FROM o)
"""


def _records(spark, d):
    """Each order supersedes the customer's one before."""
    before = F.expr("lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
    return read(spark, d, "orders").withColumn("supersedes", F.array_compact(F.array(before)))


@query(RECORDS + "SELECT o_orderkey, o_custkey, o_orderstatus FROM a WHERE alive")
def ledger_active(spark, d):
    return ledger.active(_records(spark, d), "o_orderkey", "supersedes").select("o_orderkey", "o_custkey", "o_orderstatus")


@query(
    RECORDS
    + """SELECT s.status, count(a.o_orderkey) AS history, count(a.o_orderkey) FILTER (WHERE alive) AS active
FROM (VALUES ('F'), ('O'), ('P'), ('X')) s(status) LEFT JOIN a ON a.o_orderstatus = s.status GROUP BY 1"""
)
def ledger_status_counts(spark, d):
    return ledger.status_counts(_records(spark, d), "o_orderkey", "supersedes", "o_orderstatus", ["F", "O", "P", "X"])


@query(
    """WITH o AS (SELECT o_orderkey, o_orderdate, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS wanted FROM orders)
SELECT a.o_orderkey AS "by", a.wanted FROM o a LEFT JOIN orders b ON a.wanted = b.o_orderkey WHERE a.wanted IS NOT NULL AND (b.o_orderdate IS NULL OR b.o_orderdate >= a.o_orderdate)"""
)
def ledger_forward_references(spark, d):
    before = F.expr("lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey)")
    rows = read(spark, d, "orders").withColumn("supersedes", F.array_compact(F.array(before)))
    return ledger.unknown_references(rows, "o_orderkey", "supersedes", "o_orderdate")


@query(
    """SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order FROM orders GROUP BY 1"""
)
def last_wins(spark, d):
    rows = read(spark, d, "orders").withColumn("at", F.struct("o_orderdate", "o_orderkey"))
    return ledger.last_wins(rows, "o_custkey", "at").select("o_custkey", F.col("o_orderkey").alias("last_order"))


@query(
    """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(avg(l_discount), 6) AS avg_discount, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL"""
)
def pricing_summary(spark, d):
    lines = read(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return lines.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_price"), F.round(F.avg("l_discount"), 6).alias("avg_discount"), F.count("*").alias("n")
    )


@query(
    """WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'Bad id' ELSE 'rec.' || o_orderkey END AS record_id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || CASE WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 7 = 1 THEN '+05:30' ELSE 'Z' END AS recorded_at, o_orderkey % 13 = 0 AS blank, o_orderstatus = 'F' AND o_orderkey % 5 = 0 AS bare FROM orders),
b AS (SELECT o_orderkey, record_id, recorded_at, list_filter([CASE WHEN o_orderkey % 11 = 0 THEN 'id' END, CASE WHEN o_orderkey % 7 = 0 THEN 'time' END, CASE WHEN blank THEN 'summary' END, CASE WHEN bare THEN 'F_evidence' END], lambda x: x IS NOT NULL) AS broken FROM r)
SELECT o_orderkey, record_id, recorded_at, broken FROM b WHERE len(broken) > 0"""
)
def record_rules(spark, d):
    """Records with an unsafe id, a time without an offset, a blank summary, or without the evidence that their status needs."""
    i = F.col("o_orderkey")
    offset = F.when(i % 7 == 0, "").when(i % 7 == 1, "+05:30").otherwise("Z")
    rows = read(spark, d, "orders").select(
        "o_orderkey", F.when(i % 11 == 0, "Bad id").otherwise(F.concat(F.lit("rec."), i)).alias("record_id"), F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), offset).alias("recorded_at"),
        F.when(i % 13 == 0, "  ").otherwise("done").alias("summary"), F.col("o_orderstatus").alias("status"), F.when((F.col("o_orderstatus") == "F") & (i % 5 == 0), F.array().cast("array<string>")).otherwise(F.array(F.lit("x"))).alias("evidence"),
    )
    return gates.violations(rows, ledger.record_rules({"F": ["evidence"]})).select("o_orderkey", "record_id", "recorded_at", "broken")
