"""The same fixtures as SQL, and a way to put the needed ones in front of a query."""

from __future__ import annotations

FIXTURES: dict[str, tuple[tuple[str, ...], str]] = {
    "chg": (
        (),
        """SELECT CAST(16384 + user_id % 4 AS BIGINT) AS relation_oid,
       event_id + 1 AS lsn,
       CAST((event_id - event_id % 8) / 8 AS BIGINT) AS xid,
       event_id - event_id % 8 + 8 AS final_lsn,
       ts, user_id AS k,
       CASE WHEN event_type = 'error' THEN 'D'
            WHEN prev_type IS NULL OR prev_type = 'error' THEN 'I' ELSE 'U' END AS op,
       CASE WHEN event_type = 'error' THEN NULL
            WHEN event_id % 10 = 0 THEN 'n' ELSE 't' END AS value_kind,
       CASE WHEN event_type = 'error' OR event_id % 10 = 0 THEN NULL ELSE value END AS value,
       CASE WHEN event_type = 'error' THEN NULL
            WHEN event_type = 'view' AND prev_type IS NOT NULL AND prev_type <> 'error' THEN 'u' ELSE 't' END AS props_kind,
       CASE WHEN event_type = 'error' OR (event_type = 'view' AND prev_type IS NOT NULL AND prev_type <> 'error')
            THEN NULL ELSE props END AS props
FROM (SELECT event_id, ts, user_id, event_type, value, props,
             lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS prev_type FROM events) ev
WHERE NOT (event_type = 'error' AND (prev_type IS NULL OR prev_type = 'error'))""",
    ),
    "chg_ctl": (
        ("chg",),
        """SELECT relation_oid, min(lsn) * 10 - 1 AS pos, 'begin' AS msg_type, xid, final_lsn, CAST(NULL AS BIGINT) AS k
FROM chg GROUP BY relation_oid, xid, final_lsn
UNION ALL
SELECT relation_oid, lsn * 10, CASE op WHEN 'I' THEN 'insert' WHEN 'U' THEN 'update' ELSE 'delete' END,
       CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), k FROM chg
UNION ALL
SELECT relation_oid, max(lsn) * 10 + 1, 'commit', CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT)
FROM chg WHERE xid < (SELECT max(xid) FROM chg) GROUP BY relation_oid, xid, final_lsn""",
    ),
    "stitched": (
        ("chg_ctl",),
        """SELECT relation_oid, pos, msg_type, k,
       last_value(xid IGNORE NULLS) OVER w AS xid, last_value(final_lsn IGNORE NULLS) OVER w AS final_lsn
FROM chg_ctl WINDOW w AS (PARTITION BY relation_oid ORDER BY pos ROWS UNBOUNDED PRECEDING)""",
    ),
    # The canonical messages of ``chg`` with their stitched headers.
    "messages": (
        ("chg",),
        """SELECT m.*,
       last_value(tx IGNORE NULLS) OVER w AS xid, last_value(lsn IGNORE NULLS) OVER w AS final_lsn,
       last_value(tx_us IGNORE NULLS) OVER w AS commit_us
FROM (SELECT relation_oid, min(lsn) * 100 - 40 AS pos, 'begin' AS msg_type, xid AS tx, final_lsn AS lsn, epoch_us(max(ts)) AS tx_us,
             epoch_us(max(ts)) AS own_us, CAST(NULL AS BIGINT) AS k, NULL AS value_kind, NULL AS value, NULL AS props_kind, NULL AS props
      FROM chg GROUP BY relation_oid, xid, final_lsn
      UNION ALL
      SELECT relation_oid, lsn * 100, CASE op WHEN 'I' THEN 'insert' WHEN 'U' THEN 'update' ELSE 'delete' END, NULL, NULL, NULL, NULL,
             k, value_kind, CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR), props_kind, props FROM chg
      UNION ALL
      SELECT relation_oid, max(lsn) * 100 + 50, 'commit', NULL, NULL, NULL, epoch_us(max(ts)), NULL, NULL, NULL, NULL, NULL
      FROM chg WHERE xid < (SELECT max(xid) FROM chg) GROUP BY relation_oid, xid, final_lsn
      UNION ALL
      SELECT relation_oid, min(lsn) * 100 - 20, 'relation', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL
      FROM chg GROUP BY relation_oid) m
WINDOW w AS (PARTITION BY relation_oid ORDER BY pos ROWS UNBOUNDED PRECEDING)""",
    ),
    "done": (("chg",), "SELECT * FROM chg WHERE xid < (SELECT max(xid) FROM chg)"),
    # Live rows after all committed changes.
    "done_image": (
        ("done",),
        """SELECT a.relation_oid, a.k, v.value, p.props
FROM (SELECT relation_oid, k, max(CASE WHEN op = 'I' THEN lsn END) AS li, max(CASE WHEN op = 'D' THEN lsn END) AS ld,
             max(CASE WHEN value_kind <> 'u' THEN lsn END) AS mv, max(CASE WHEN props_kind <> 'u' THEN lsn END) AS mp
      FROM done GROUP BY relation_oid, k) a
JOIN done v ON v.lsn = a.mv JOIN done p ON p.lsn = a.mp
WHERE a.li > coalesce(a.ld, 0)""",
    ),
    "base": (
        ("chg",),
        """SELECT relation_oid, share - share % 8 AS start_lsn
FROM (SELECT DISTINCT relation_oid, (SELECT max(final_lsn) FROM chg) * (relation_oid - 16383) // 5 AS share FROM chg) shares""",
    ),
    "chg_full": (
        (),
        """SELECT event_type AS t, g, event_id + 1 AS lsn, 1 AS w
FROM (SELECT event_id, event_type, user_id % 7 AS g FROM events) c WHERE event_type <> 'error'
UNION ALL
SELECT pt, g, event_id + 1, -1
FROM (SELECT event_id, user_id % 7 AS g,
             lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS pt FROM events) d
WHERE pt IS NOT NULL AND pt <> 'error'""",
    ),
    "catalog": (
        (),
        """SELECT n.n_nationkey AS oid, r.r_name AS nspname, n.n_name AS relname,
       pk.s_nationkey IS NOT NULL AS has_pk,
       CASE n.n_nationkey % 4 WHEN 0 THEN 'd' WHEN 1 THEN 'n' WHEN 2 THEN 'i' ELSE 'f' END AS replica_identity
FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey
     JOIN (SELECT c_nationkey FROM customer GROUP BY c_nationkey
           HAVING count(*) >= (SELECT avg(n) FROM (SELECT count(*) AS n FROM customer GROUP BY c_nationkey))) pub ON pub.c_nationkey = n.n_nationkey
     LEFT JOIN (SELECT s_nationkey FROM supplier GROUP BY s_nationkey
                HAVING count(*) >= (SELECT avg(n) FROM (SELECT count(*) AS n FROM supplier GROUP BY s_nationkey))) pk ON pk.s_nationkey = n.n_nationkey""",
    ),
    "renames": (
        (),
        "SELECT o_custkey AS relation_oid, o_orderkey + 1 AS lsn, o_orderpriority AS name FROM orders",
    ),
    "segs": (
        ("chg",),
        """SELECT relation_oid, CAST(sess AS BIGINT) AS sess, CAST((rn - rn % 50) / 50 AS BIGINT) AS part,
       min(final_lsn) AS min_lsn, max(final_lsn) AS max_lsn, count(*) AS n, min(ts) AS min_ts, max(ts) AS max_ts
FROM (SELECT *, row_number() OVER (PARTITION BY relation_oid, sess ORDER BY lsn) - 1 AS rn
      FROM (SELECT *, sum(brk) OVER (PARTITION BY relation_oid ORDER BY lsn ROWS UNBOUNDED PRECEDING) AS sess
            FROM (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 3600000000 THEN 1 ELSE 0 END AS brk
                  FROM chg WINDOW w AS (PARTITION BY relation_oid ORDER BY lsn)) g) h) i
GROUP BY relation_oid, sess, CAST((rn - rn % 50) / 50 AS BIGINT)""",
    ),
    "orders_b": (
        (),
        """SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 97 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus
FROM orders WHERE o_orderkey % 101 <> 0""",
    ),
    "moves_expected": (
        (),
        """SELECT o_orderkey + CASE WHEN o_orderkey % 20 = 0 THEN 20000000 WHEN o_orderkey % 10 = 0 THEN 10000000 ELSE 0 END AS k, o_orderstatus AS status FROM orders
UNION ALL SELECT o_orderkey, 'R' FROM orders WHERE o_orderkey % 40 = 0""",
    ),
    # Live rows after all changes: per column the newest sent cell of the keys that are alive.
    "image": (
        ("chg",),
        """SELECT a.relation_oid, a.k, v.value, p.props
FROM (SELECT relation_oid, k, max(CASE WHEN op = 'I' THEN lsn END) AS li, max(CASE WHEN op = 'D' THEN lsn END) AS ld,
             max(CASE WHEN value_kind <> 'u' THEN lsn END) AS mv, max(CASE WHEN props_kind <> 'u' THEN lsn END) AS mp
      FROM chg GROUP BY relation_oid, k) a
JOIN chg v ON v.lsn = a.mv JOIN chg p ON p.lsn = a.mp
WHERE a.li > coalesce(a.ld, 0)""",
    ),
    # The same as of each relation's base position.
    "base_image": (
        ("chg", "base"),
        """SELECT a.relation_oid, a.k, v.value, p.props
FROM (SELECT c.relation_oid, c.k, max(CASE WHEN op = 'I' THEN lsn END) AS li, max(CASE WHEN op = 'D' THEN lsn END) AS ld,
             max(CASE WHEN value_kind <> 'u' THEN lsn END) AS mv, max(CASE WHEN props_kind <> 'u' THEN lsn END) AS mp
      FROM chg c JOIN base b ON b.relation_oid = c.relation_oid WHERE c.final_lsn <= b.start_lsn
      GROUP BY c.relation_oid, c.k) a
JOIN chg v ON v.lsn = a.mv JOIN chg p ON p.lsn = a.mp
WHERE a.li > coalesce(a.ld, 0)""",
    ),
    "trunc_expected": (
        ("chg", "base"),
        """SELECT pv.relation_oid, pv.k, v.value, p.props
FROM (SELECT c.relation_oid, c.k, max(CASE WHEN op = 'I' THEN lsn END) AS li, max(CASE WHEN op = 'D' THEN lsn END) AS ld,
             max(CASE WHEN props_kind <> 'u' THEN lsn END) AS mp, max(CASE WHEN value_kind <> 'u' THEN lsn END) AS mv
      FROM chg c JOIN base ON base.relation_oid = c.relation_oid WHERE c.lsn > start_lsn
      GROUP BY c.relation_oid, c.k) pv
JOIN chg v ON v.lsn = pv.mv JOIN chg p ON p.lsn = pv.mp
WHERE pv.li > coalesce(pv.ld, 0)""",
    ),
}


def at_share(fifths: int) -> str:
    """The transaction end at so many fifths of the log ``chg``."""
    return f"(SELECT (max(final_lsn) * {fifths} // 5) - (max(final_lsn) * {fifths} // 5) % 8 FROM chg)"


def _needed(names: tuple[str, ...], seen: list[str]) -> list[str]:
    for name in names:
        if name not in seen:
            _needed(FIXTURES[name][0], seen)
            seen.append(name)
    return seen


def with_fixtures(*names: str, body: str) -> str:
    """``body`` preceded by the fixtures it reads, each after those it needs."""
    parts = [f"{n} AS (\n{FIXTURES[n][1]}\n)" for n in _needed(names, [])]
    return f"WITH {', '.join(parts)}\n{body}" if parts else body
