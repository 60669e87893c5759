"""The registered queries in DuckDB SQL over the same Parquet views."""

from __future__ import annotations

# Exact integers: prices in cents, discounts in per cent, revenue in ten-thousandths.
LINES = "SELECT l_orderkey, l_linenumber, l_partkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, CAST(round(l_discount * 100) AS BIGINT) AS pct FROM lineitem WHERE l_returnflag = 'R'"
ORDERS = "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-10-01' AND o_orderdate < TIMESTAMP '1997-01-01'"
CUSTOMERS = "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal FROM customer"
NATIONS = "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation"
RELS = f"l AS ({LINES}), o AS ({ORDERS}), c AS ({CUSTOMERS}), n AS ({NATIONS})"
REV = "cents * (100 - pct)"
CHAIN = "j AS (SELECT * FROM l JOIN o ON l_orderkey = o_orderkey JOIN c ON o_custkey = c_custkey JOIN n ON c_nationkey = n_nationkey)"
VIEW = f"v AS (SELECT c_custkey, c_name, CAST(sum({REV}) AS BIGINT) AS revenue_e4, c_acctbal, n_name FROM j GROUP BY c_custkey, c_name, c_acctbal, n_name)"

LOGS = """
ll AS (SELECT *, 1 AS op, CAST((l_orderkey + l_linenumber) % 4 AS BIGINT) AS batch FROM l UNION ALL SELECT *, -1, CAST(5 AS BIGINT) FROM l WHERE l_partkey % 11 = 0),
ol AS (SELECT *, 1 AS op, CAST(o_orderkey % 4 AS BIGINT) AS batch FROM o UNION ALL SELECT *, -1, CAST(4 + o_orderkey % 2 AS BIGINT) FROM o WHERE o_orderkey % 13 = 0 UNION ALL SELECT *, 1, CAST(6 AS BIGINT) FROM o WHERE o_orderkey % 26 = 0),
cl AS (SELECT *, 1 AS op, CAST(0 AS BIGINT) AS batch FROM c UNION ALL SELECT *, -1, CAST(6 AS BIGINT) FROM c WHERE c_custkey % 17 = 0),
nl AS (SELECT *, 1 AS op, CAST(0 AS BIGINT) AS batch FROM n UNION ALL SELECT *, -1, CAST(7 AS BIGINT) FROM n WHERE n_nationkey = 7)
"""
# All changes of the product of weights: of every combination of changes the last batch is when it takes effect.
DELTAS = f"""
dd AS (SELECT l_orderkey, l_linenumber, l_partkey, cents, pct, c_custkey, n_name, greatest(ll.batch, ol.batch, cl.batch, nl.batch) AS batch,
  CAST(sum(ll.op * ol.op * cl.op * nl.op) AS BIGINT) AS op
  FROM ll JOIN ol ON l_orderkey = o_orderkey JOIN cl ON o_custkey = c_custkey JOIN nl ON c_nationkey = n_nationkey
  GROUP BY ALL HAVING sum(ll.op * ol.op * cl.op * nl.op) <> 0)
"""
G = f"g AS (SELECT c_custkey, CAST(sum(op * {REV}) AS BIGINT) AS revenue_e4, CAST(sum(op) AS BIGINT) AS cnt FROM dd GROUP BY c_custkey)"
BASE = f"WITH {RELS}"
LOGGED = f"{BASE}, {LOGS}"
DELTA = f"{LOGGED}, {DELTAS}"
SNAPS = f"""
b AS (SELECT CAST(range AS BIGINT) AS batch FROM range(8)),
s AS (SELECT b.batch, c_custkey, CAST(sum(op * {REV}) AS BIGINT) AS revenue_e4, sum(op) AS cnt FROM b JOIN dd ON dd.batch <= b.batch GROUP BY b.batch, c_custkey HAVING sum(op) > 0 AND sum(op * {REV}) > 0),
t AS (SELECT batch, row_number() OVER (PARTITION BY batch ORDER BY revenue_e4 DESC, c_custkey) AS rank, c_custkey, revenue_e4 FROM s QUALIFY rank <= 20),
h AS (SELECT batch, string_agg(c_custkey || ':' || revenue_e4, ',' ORDER BY rank) AS top FROM t GROUP BY batch),
x AS (SELECT batch, top IS DISTINCT FROM lag(top) OVER (ORDER BY batch) AS changed FROM h)
"""
# The same with all nations gone in batch 8 and back in batch 10; an empty ranking is a batch like others.
EMPTIED = f"""{LOGGED.replace("n_nationkey = 7", "n_nationkey = 7 UNION ALL SELECT *, -1, CAST(8 AS BIGINT) FROM n WHERE n_nationkey <> 7 UNION ALL SELECT *, 1, CAST(10 AS BIGINT) FROM n WHERE n_nationkey <> 7")}, {DELTAS}, {SNAPS.split("h AS")[0].replace("range(8)", "range(12)")}
h AS (SELECT b.batch, coalesce(string_agg(c_custkey || ':' || revenue_e4, ',' ORDER BY rank), '') AS top FROM b LEFT JOIN t ON b.batch = t.batch GROUP BY b.batch),
x AS (SELECT batch, top <> lag(top, 1, '') OVER (ORDER BY batch) AS changed FROM h)
"""
KEYED = [("region", "r_regionkey"), ("nation", "n_nationkey"), ("supplier", "s_suppkey"), ("customer", "c_custkey"), ("part", "p_partkey"), ("orders", "o_orderkey"), ("lineitem", "l_orderkey,l_linenumber")]
REFERS = [("nation", "n_regionkey", "region", "r_regionkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey")]
GAPPY = f"{BASE}, lc AS (SELECT * FROM c WHERE c_custkey % 17 <> 0), lo AS (SELECT * FROM o WHERE o_custkey IN (SELECT c_custkey FROM lc WHERE c_nationkey IN (SELECT n_nationkey FROM n)))"
KEYS = "SELECT 'lineitem' AS relation, op, batch, l_orderkey AS k FROM ll UNION ALL SELECT 'orders', op, batch, o_orderkey FROM ol UNION ALL SELECT 'customer', op, batch, c_custkey FROM cl UNION ALL SELECT 'nation', op, batch, n_nationkey FROM nl"
LIVE_AT = "(SELECT o_orderkey FROM (SELECT o_orderkey, o_custkey FROM ol WHERE batch <= {b} GROUP BY ALL HAVING sum(op) > 0) WHERE o_custkey IN (SELECT c_custkey FROM (SELECT c_custkey, c_nationkey FROM cl WHERE batch <= {b} GROUP BY ALL HAVING sum(op) > 0) WHERE c_nationkey IN (SELECT n_nationkey FROM nl WHERE batch <= {b} GROUP BY n_nationkey HAVING sum(op) > 0)))"
_BATCHES = "SELECT CAST(range AS BIGINT) AS batch FROM range(8)"
# The live rows after each batch, from the nations on; each batch against the one before.
LIVE_STATES = f"""b AS ({_BATCHES}),
nv AS (SELECT DISTINCT b.batch, n_nationkey FROM b JOIN nl ON nl.batch <= b.batch GROUP BY b.batch, n_nationkey, n_name HAVING sum(op) > 0),
cv AS (SELECT b.batch, c_custkey, c_nationkey FROM b JOIN cl ON cl.batch <= b.batch GROUP BY b.batch, c_custkey, c_nationkey, c_name, c_acctbal HAVING sum(op) > 0 AND (b.batch, c_nationkey) IN (SELECT batch, n_nationkey FROM nv)),
ov AS (SELECT b.batch, o_orderkey, o_custkey FROM b JOIN ol ON ol.batch <= b.batch GROUP BY b.batch, o_orderkey, o_custkey HAVING sum(op) > 0 AND (b.batch, o_custkey) IN (SELECT batch, c_custkey FROM cv)),
lv AS (SELECT b.batch, l_orderkey, l_linenumber, l_partkey, cents, pct FROM b JOIN ll ON ll.batch <= b.batch GROUP BY ALL HAVING sum(op) > 0 AND (b.batch, l_orderkey) IN (SELECT batch, o_orderkey FROM ov)),
lives AS (SELECT 'nation' AS relation, n_nationkey AS k, CAST(NULL AS INTEGER) AS l_linenumber, CAST(NULL AS BIGINT) AS l_partkey, CAST(NULL AS BIGINT) AS cents, CAST(NULL AS BIGINT) AS pct, batch FROM nv
  UNION ALL SELECT 'customer', c_custkey, NULL, NULL, NULL, NULL, batch FROM cv UNION ALL SELECT 'orders', o_orderkey, NULL, NULL, NULL, NULL, batch FROM ov
  UNION ALL SELECT 'lineitem', l_orderkey, CAST(l_linenumber AS INTEGER), l_partkey, cents, pct, batch FROM lv)"""
DIFF = f"{DELTA}, {G}, a AS (SELECT c_custkey, revenue_e4 FROM g WHERE cnt > 0), p AS (SELECT o_custkey AS c_custkey, CAST(sum({REV}) AS BIGINT) AS revenue_e4 FROM l JOIN o ON l_orderkey = o_orderkey GROUP BY o_custkey)"
MONTHS = "SELECT strftime(o_orderdate, '%Y-%m') AS run_id, CAST(count(*) AS BIGINT) AS u, CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS BIGINT) AS d, CAST(count(DISTINCT o_custkey) AS BIGINT) AS g FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1"

ORACLES = {
    "q10_top20": f"{BASE}, {CHAIN}, {VIEW} SELECT * FROM v ORDER BY revenue_e4 DESC, c_custkey LIMIT 20",
    "q10_all": f"{BASE}, {CHAIN}, {VIEW} SELECT * FROM v",
    "fk_chain_join": f"{BASE}, {CHAIN} SELECT l_orderkey, l_linenumber, l_partkey, c_custkey, n_name, {REV} AS revenue_e4 FROM j",
    "fk_chain_join_bucketed": f"{BASE}, {CHAIN} SELECT l_orderkey, l_linenumber, l_partkey, c_custkey, n_name, {REV} AS revenue_e4 FROM j",
    "revenue_by_customer": f"{BASE} SELECT o_custkey AS c_custkey, CAST(sum({REV}) AS BIGINT) AS revenue_e4, count(*) AS cnt FROM l JOIN o ON l_orderkey = o_orderkey GROUP BY o_custkey",
    "revenue_exact": "SELECT l_returnflag, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT))) AS BIGINT) AS revenue_e4 FROM lineitem GROUP BY l_returnflag",
    "revenue_cents": "SELECT l_returnflag, CAST(sum(p - p * bp // 10000) AS BIGINT) AS revenue_cents FROM (SELECT l_returnflag, CAST(round(l_extendedprice * 100) AS BIGINT) AS p, CAST(round(l_discount * 10000) AS BIGINT) AS bp FROM lineitem) GROUP BY l_returnflag",
    "scalar_money": "SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) AS price_cents, -CAST(round(l_extendedprice * 100) AS BIGINT) AS negative_cents, CAST(round(l_discount * 10000) AS BIGINT) AS discount_units FROM lineitem",
    "tbl_round_trip": "SELECT l_orderkey, CAST(l_linenumber AS INTEGER) AS l_linenumber, o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, l_returnflag, CAST(round(l_extendedprice * 100) AS BIGINT) AS extendedprice_cents, CAST(round(l_discount * 100) AS BIGINT) AS discount_cents FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "filter_orders_window": "SELECT o_orderkey, o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1996-10-01' AND o_orderdate < TIMESTAMP '1997-01-01'",
    "filter_returned": "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag = 'R'",
    "live_customers": f"{GAPPY} SELECT c_custkey, c_name FROM lc WHERE c_nationkey IN (SELECT n_nationkey FROM n)",
    "live_orders": f"{GAPPY} SELECT o_orderkey, o_custkey FROM lo",
    "live_lineitems": f"{GAPPY} SELECT l_orderkey, l_linenumber, l_partkey FROM l WHERE l_orderkey IN (SELECT o_orderkey FROM lo)",
    "nonlive_lineitems": f"{GAPPY} SELECT l_orderkey, l_linenumber, l_partkey FROM l WHERE l_orderkey NOT IN (SELECT o_orderkey FROM lo)",
    "alive_counter": f"{GAPPY} SELECT o_orderkey, CAST(CASE WHEN o_custkey IN (SELECT c_custkey FROM lc) THEN 1 ELSE 0 END AS BIGINT) AS alive FROM o",
    "parents_of": f"{BASE} SELECT o_custkey, CAST(count(*) AS INTEGER) AS n_parents, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS parents FROM (SELECT DISTINCT o_custkey, o_orderkey FROM o) GROUP BY o_custkey",
    "parent_pairs": f"{BASE} SELECT DISTINCT o_custkey, o_orderkey FROM o",
    "liveness_changes": f"{LOGGED}, a AS {LIVE_AT.format(b=5)}, z AS {LIVE_AT.format(b=6)} SELECT o_orderkey, -1 AS change FROM (SELECT * FROM a EXCEPT SELECT * FROM z) UNION ALL SELECT o_orderkey, 1 FROM (SELECT * FROM z EXCEPT SELECT * FROM a)",
    "liveness_deltas": f"{LOGGED}, {LIVE_STATES}, later AS (SELECT * REPLACE (batch + 1 AS batch) FROM lives WHERE batch < 7) SELECT *, 1 AS change FROM (SELECT * FROM lives EXCEPT SELECT * FROM later) UNION ALL SELECT *, -1 FROM (SELECT * FROM later EXCEPT SELECT * FROM lives)",
    "fk_orphans": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 17 <> 0)",
    "pk_duplicates": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1",
    "schema_integrity": " UNION ALL ".join(
        [f"SELECT '{n}' AS relation, 'pk {k}' AS \"constraint\", count(*) AS n_bad FROM (SELECT {k} FROM {n} GROUP BY {k} HAVING count(*) > 1)" for n, k in KEYED]
        + [f"SELECT '{c}', 'fk {f}', count(*) FROM {c} WHERE {f} IS NOT NULL AND {f} NOT IN (SELECT {k} FROM {p} WHERE {k} IS NOT NULL)" for c, f, p, k in REFERS]
    ),
    "column_checks": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS n_null, {f'CAST(max(length({c})) AS INTEGER)' if limit else 'CAST(NULL AS INTEGER)'} AS max_length, ({'count(*) = count(' + c + ')' if required else 'true'}) AND ({f'max(length({c})) <= {limit}' if limit else 'true'}) AS ok FROM customer"
        for c, required, limit in (("c_custkey", True, 0), ("c_name", True, 25), ("c_nationkey", True, 0), ("c_mktsegment", False, 10))
    ),
    "changelog_bulk": f"{BASE} SELECT 'nation' AS relation, 1 AS op, CAST(0 AS BIGINT) AS batch, n_nationkey AS k FROM n UNION ALL SELECT 'customer', 1, 1, c_custkey FROM c UNION ALL SELECT 'orders', 1, 2, o_orderkey FROM o UNION ALL SELECT 'lineitem', 1, 3, l_orderkey FROM l",
    "changelog_mixed": f"{LOGGED} {KEYS}",
    "changelog_filtered": f"{BASE} SELECT 'orders' AS relation, o_orderkey AS k, 1 AS op, CAST(0 AS BIGINT) AS batch FROM o UNION ALL SELECT 'orders', o_orderkey, -1, 1 FROM o WHERE o_orderkey % 13 = 0 UNION ALL SELECT 'lineitem', l_orderkey, 1, 0 FROM l",
    "changelog_pairs": "SELECT o_orderkey, o_custkey, s AS o_orderstatus, o_totalprice, op, CAST(4 + o_orderkey % 10 AS BIGINT) AS batch FROM orders, (VALUES ('O', -1), ('F', 1)) AS x(s, op)",
    "count_updates": f"{LOGGED} SELECT relation, op, count(*) AS n FROM ({KEYS}) GROUP BY relation, op",
    "assign_batches": "SELECT o_orderkey, seq, CAST((seq - 1) // 100 AS BIGINT) AS batch FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS seq FROM orders)",
    "net_changes": f"{LOGGED} SELECT o_orderkey, o_custkey, batch, CAST(sum(op) AS BIGINT) AS op FROM ol GROUP BY o_orderkey, o_custkey, batch HAVING sum(op) <> 0",
    "row_versions": f"{LOGGED}, w AS (SELECT o_orderkey, o_custkey, batch, sum(op) AS op FROM ol GROUP BY ALL HAVING sum(op) <> 0) SELECT o_orderkey, o_custkey, from_batch, to_batch, m FROM (SELECT o_orderkey, o_custkey, batch AS from_batch, lead(batch) OVER p AS to_batch, CAST(sum(op) OVER p AS BIGINT) AS m FROM w WINDOW p AS (PARTITION BY o_orderkey, o_custkey ORDER BY batch)) WHERE m <> 0",
    "validate_changelog": f"{LOGGED}, w AS (SELECT l_orderkey, l_linenumber, batch, sum(op) AS op FROM ll GROUP BY ALL) SELECT l_orderkey, l_linenumber, batch, weight, CASE WHEN weight < 0 THEN 'negative' ELSE 'duplicate' END AS problem FROM (SELECT l_orderkey, l_linenumber, batch, CAST(sum(op) OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY batch) AS BIGINT) AS weight FROM w) WHERE weight < 0 OR weight > 1",
    "join_deltas": f"{DELTA} SELECT l_orderkey, l_linenumber, l_partkey, c_custkey, n_name, {REV} AS revenue_e4, op, batch FROM dd",
    "delta_counts": f"{DELTA} SELECT batch, CAST(sign(op) AS INTEGER) AS op, CAST(sum(abs(op)) AS BIGINT) AS n FROM dd GROUP BY 1, 2",
    "delta_join_batch": f"{DELTA} SELECT l_orderkey, l_linenumber, l_partkey, c_custkey, n_name, {REV} AS revenue_e4, op FROM dd WHERE batch = 6",
    "signed_aggregate": f"{DELTA}, {G} SELECT c_custkey, revenue_e4, cnt FROM g WHERE cnt > 0",
    "merge_partials": f"{DELTA}, {G} SELECT c_custkey, revenue_e4, cnt FROM g",
    "positive_groups": f"{DELTA}, {G} SELECT c_custkey, revenue_e4 FROM g WHERE cnt > 0 AND revenue_e4 > 0",
    "group_count": f"{DELTA}, {G} SELECT count(*) AS n_groups FROM g WHERE cnt > 0",
    "running_revenue": f"{DELTA}, r AS (SELECT c_custkey, batch, sum(op * {REV}) AS d, sum(op) AS k FROM dd GROUP BY c_custkey, batch) SELECT c_custkey, batch, CAST(sum(d) OVER w AS BIGINT) AS revenue_e4, CAST(sum(k) OVER w AS BIGINT) AS cnt FROM r WINDOW w AS (PARTITION BY c_custkey ORDER BY batch)",
    "snapshots_batch_end": f"{DELTA}, {SNAPS} SELECT batch, rank, c_custkey, revenue_e4 FROM t",
    "snapshots_written": f"{DELTA}, {SNAPS} SELECT batch, rank, c_custkey, revenue_e4 FROM t",
    "topk_changes": f"{DELTA}, {SNAPS} SELECT batch, changed FROM x",
    "snapshots_on_change": f"{DELTA}, {SNAPS} SELECT batch, rank, c_custkey, revenue_e4 FROM t WHERE batch IN (SELECT batch FROM x WHERE changed)",
    "topk_changes_emptied": f"{EMPTIED} SELECT batch, changed FROM x",
    "snapshots_on_change_emptied": f"{EMPTIED} SELECT batch, rank, c_custkey, revenue_e4 FROM t WHERE batch IN (SELECT batch FROM x WHERE changed)",
    "result_diff": f"{DIFF} SELECT c_custkey, revenue_e4, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM p) UNION ALL SELECT c_custkey, revenue_e4, 'right' FROM (SELECT * FROM p EXCEPT ALL SELECT * FROM a)",
    "result_diff_digest": f"{DIFF} SELECT c_custkey, revenue_e4, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM p) UNION ALL SELECT c_custkey, revenue_e4, 'right' FROM (SELECT * FROM p EXCEPT ALL SELECT * FROM a)",
    "result_diff_detail": f"{DIFF} SELECT coalesce(a.c_custkey, p.c_custkey) AS c_custkey, CASE WHEN p.c_custkey IS NULL THEN 'missing' WHEN a.c_custkey IS NULL THEN 'extra' WHEN a.revenue_e4 = p.revenue_e4 THEN 'same' ELSE 'changed' END AS status, a.revenue_e4 AS left_revenue_e4, p.revenue_e4 AS right_revenue_e4 FROM a FULL JOIN p ON a.c_custkey = p.c_custkey",
    "sink_csv_rows": f"{BASE}, {CHAIN}, {VIEW} SELECT c_custkey, '\"' || replace(c_name, '\"', '\"\"') || '\"' AS c_name, printf('%d.%04d', revenue_e4 // 10000, revenue_e4 % 10000) AS revenue, printf('%.2f', c_acctbal) AS c_acctbal, n_name FROM v ORDER BY revenue_e4 DESC, c_custkey LIMIT 20",
    "metrics_summary": f"SELECT run_id, proc AS processing_time_ms, greatest(u * 3 - proc, 0) AS cluster_gap_ms, CAST(floor(round(CASE WHEN base > 0 THEN u * 1000 / base ELSE 0 END, 3)) AS BIGINT) AS updates_per_sec, CAST(floor(round(CASE WHEN base > 0 THEN d * 1000 / base ELSE 0 END, 3)) AS BIGINT) AS join_deltas_per_sec FROM (SELECT *, CASE WHEN g % 2 = 1 THEN u * 3 ELSE proc END AS base FROM (SELECT *, u + d + g % 7 + 3 AS proc FROM ({MONTHS})))",
    "metrics_json": f"SELECT run_id, 'bulk' AS job, CAST(1 + g % 2 AS INTEGER) AS parallelism, u AS updates_total, d AS join_deltas_total, g AS groups_total, u * 3 AS wall_time_ms, u AS join_ms FROM ({MONTHS})",
    "stream_job_end": f"{DELTA}, {G}, a AS (SELECT c_custkey, revenue_e4 FROM g WHERE cnt > 0 AND revenue_e4 > 0) SELECT c_custkey, c_name, revenue_e4, n_name FROM a JOIN c USING (c_custkey) JOIN n ON c_nationkey = n_nationkey ORDER BY revenue_e4 DESC, c_custkey LIMIT 20",
    "stream_updates": f"{DELTA}, {G} SELECT c_custkey, revenue_e4, cnt FROM g WHERE cnt > 0",
    "stream_out_of_order": f"{DELTA}, {G} SELECT c_custkey, revenue_e4, cnt FROM g WHERE cnt > 0",
    "stream_join_deltas": f"{DELTA} SELECT l_orderkey, l_linenumber, l_partkey, c_custkey, n_name, {REV} AS revenue_e4, CAST(sum(op) AS BIGINT) AS op FROM dd GROUP BY ALL HAVING sum(op) <> 0",
    "stream_keyed_join": f"{DELTA} SELECT l_orderkey, l_linenumber, l_partkey, c_custkey, n_name, {REV} AS revenue_e4, CAST(sum(op) AS BIGINT) AS op FROM dd GROUP BY ALL HAVING sum(op) <> 0",
    "stream_revenue": f"{DELTA}, {G} SELECT c_custkey, revenue_e4, cnt FROM g",
    "stream_revenue_update": f"{DELTA}, {G} SELECT c_custkey, revenue_e4, cnt FROM g",
    "stream_update_files": f"{BASE} SELECT c_custkey, CAST(sum((cents + CASE WHEN l_orderkey % 5 = 0 THEN 100 ELSE 0 END) * (100 - pct)) AS BIGINT) AS revenue_e4, CAST(count(*) AS BIGINT) AS cnt FROM l JOIN o ON l_orderkey = o_orderkey JOIN c ON o_custkey + 1 = c_custkey JOIN n ON c_nationkey = n_nationkey GROUP BY c_custkey",
    "stream_validate": f"{LOGGED}, w AS (SELECT l_orderkey, l_linenumber, batch, sum(op) AS op FROM ll GROUP BY ALL) SELECT l_orderkey, l_linenumber, batch, weight, CASE WHEN weight < 0 THEN 'negative' ELSE 'duplicate' END AS problem FROM (SELECT l_orderkey, l_linenumber, batch, CAST(sum(op) OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY batch) AS BIGINT) AS weight FROM w) WHERE weight < 0 OR weight > 1",
    "run_record": f"{DELTA}, {G}, {SNAPS} SELECT 'replay' AS job, (SELECT count(*) FROM ({KEYS})) AS updates_total, CAST((SELECT sum(abs(op)) FROM dd) AS BIGINT) AS join_deltas_total, (SELECT count(*) FROM g WHERE cnt > 0) AS groups_total, (SELECT count(DISTINCT batch) FROM t) AS snapshots_total, true AS phases, true AS within_wall_time",
    "stream_topk": f"{DELTA}, {SNAPS} SELECT batch, rank, c_custkey, revenue_e4 FROM t WHERE batch IN (3, 5, 7)",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
