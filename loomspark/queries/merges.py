"""Series that are merged at seams."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.operators import merging
from loomspark.queries import query, read

_SERIES = """WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value, count(*) OVER (PARTITION BY user_id) AS n FROM events),
l AS (SELECT user_id, i, value AS v FROM e WHERE i < n * 5 // 10), a AS (SELECT user_id, i, value * 0.9 + 5 AS v FROM e WHERE i >= n * 3 // 10 AND i < n * 8 // 10), r AS (SELECT user_id, i, value * 1.1 - 5 AS v FROM e WHERE i >= n * 6 // 10),
c AS (SELECT user_id, i, abs(lag(l.v) OVER w - a.v) AS cost FROM l JOIN a USING (user_id, i) WINDOW w AS (PARTITION BY user_id ORDER BY i)),
x AS (SELECT user_id, i, abs(lag(a.v) OVER w - r.v) AS cost FROM a JOIN r USING (user_id, i) WINDOW w AS (PARTITION BY user_id ORDER BY i)),
f AS (SELECT user_id, arg_min(i, (cost, i)) AS entry, min(cost) AS entry_cost FROM c WHERE cost IS NOT NULL GROUP BY 1),
o AS (SELECT user_id, arg_min(i, (x.cost, i)) AS exit, min(x.cost) AS exit_cost FROM x JOIN f USING (user_id) WHERE x.cost IS NOT NULL AND i >= entry + 3 + 4 GROUP BY 1),
s AS (SELECT user_id, entry, entry_cost, exit, exit_cost, entry + 2 AS a_from, exit - 2 AS a_to FROM f LEFT JOIN o USING (user_id))"""


def _sides(spark, d):
    """Three overlapping parts of each user's values, the anchor and the right one on other scales."""
    rows = read(spark, d, "events").select("user_id", F.expr("row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1").alias("i"), "value", F.expr("count(*) OVER (PARTITION BY user_id)").alias("n"))
    part = lambda low, high: (F.col("i") >= F.expr(f"n * {low} DIV 10")) & (F.col("i") < F.expr(f"n * {high} DIV 10"))
    left, anchor, right = (rows.filter(part(*bounds)).select("user_id", "i", v.alias("v")) for bounds, v in (((0, 5), F.col("value")), ((3, 8), F.col("value") * 0.9 + 5), ((6, 10), F.col("value") * 1.1 - 5)))
    return left, anchor, right


@query(_SERIES + " SELECT user_id, entry, round(entry_cost, 6) AS entry_cost, exit, round(exit_cost, 6) AS exit_cost, CASE WHEN exit IS NOT NULL THEN a_from END AS retained_start, a_to AS retained_end, a_to - a_from AS retained FROM s")
def anchored_seams(spark, d):
    """Where three parts of each user's series are joined so that three values of the middle one stay as they are."""
    seams, _ = merging.merge_anchored(*_sides(spark, d), ["user_id"], "i", "v", 3, 2)
    long = lambda c: F.col(c).cast("long").alias(c)
    return seams.select("user_id", long("entry"), F.round("entry_cost", 6).alias("entry_cost"), long("exit"), F.round("exit_cost", 6).alias("exit_cost"), *map(long, ("retained_start", "retained_end", "retained")))


@query(
    _SERIES
    + """, g AS (SELECT user_id, min(i) AS first, max(i) AS last, 'l' AS side FROM l GROUP BY 1 UNION ALL SELECT user_id, min(i), max(i), 'a' FROM a GROUP BY 1 UNION ALL SELECT user_id, min(i), max(i), 'r' FROM r GROUP BY 1),
b AS (SELECT s.user_id, greatest(a.first, entry - 2) AS p, least(l.last + 1, a.last + 1, entry + 2) AS q, greatest(r.first, entry + 6, exit - 2) AS y, least(a.last + 1, r.last + 1, exit + 2) AS z
  FROM s JOIN g l ON l.user_id = s.user_id AND l.side = 'l' JOIN g a ON a.user_id = s.user_id AND a.side = 'a' JOIN g r ON r.user_id = s.user_id AND r.side = 'r' WHERE exit IS NOT NULL),
m AS (SELECT e.user_id, e.i, l.v AS l, a.v AS a, r.v AS r, p, q, y, z, 0.5 - 0.5 * cos(pi() * (e.i - p + 1) / (q - p + 1)) AS h, 0.5 - 0.5 * cos(pi() * (e.i - y + 1) / (z - y + 1)) AS k
  FROM e JOIN b USING (user_id) LEFT JOIN l ON l.user_id = e.user_id AND l.i = e.i LEFT JOIN a ON a.user_id = e.user_id AND a.i = e.i LEFT JOIN r ON r.user_id = e.user_id AND r.i = e.i)
SELECT user_id, i, round(CASE WHEN i < p THEN l WHEN i < q THEN l * (1 - h) + a * h WHEN i < y THEN a WHEN i < z THEN a * (1 - k) + r * k ELSE r END, 6) AS v,
  CASE WHEN i < p THEN 'left' WHEN i < q THEN 'entry' WHEN i < y THEN 'anchor' WHEN i < z THEN 'exit' ELSE 'right' END AS part FROM m"""
)
def anchored_merge(spark, d):
    """The merged values themselves."""
    _, merged = merging.merge_anchored(*_sides(spark, d), ["user_id"], "i", "v", 3, 2)
    return merged.select("user_id", F.col("i").cast("long").alias("i"), F.round("v", 6).alias("v"), "part")
