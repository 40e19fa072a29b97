"""Change logs, catalogs and manifests derived from the given tables, as DataFrames.

Each function mirrors one named SQL fixture in ``oracles.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.functions.lsn import as_micros


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _with_previous_type(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """A plain window, so that the log is read once and not made by an operator under test."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", *columns)
    before = Window.partitionBy("user_id").orderBy("event_id")
    return events.withColumn("prev_type", F.lag("event_type").over(before))


def chg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed change log over ``events``: one row per change, four relations."""
    ev = _with_previous_type(spark, sf_dir, "ts", "value", "props")
    fresh = "(prev_type IS NULL OR prev_type = 'error')"
    unchanged = f"(event_type = 'view' AND NOT {fresh})"
    return ev.where(f"NOT (event_type = 'error' AND {fresh})").selectExpr(
        "CAST(16384 + user_id % 4 AS BIGINT) AS relation_oid",
        "event_id + 1 AS lsn",
        "CAST((event_id - event_id % 8) / 8 AS BIGINT) AS xid",
        "event_id - event_id % 8 + 8 AS final_lsn",
        "ts",
        "user_id AS k",
        f"CASE WHEN event_type = 'error' THEN 'D' WHEN {fresh} THEN 'I' ELSE 'U' END AS op",
        "CASE WHEN event_type = 'error' THEN NULL WHEN event_id % 10 = 0 THEN 'n' ELSE 't' END AS value__kind",
        "CASE WHEN event_type <> 'error' AND event_id % 10 <> 0 THEN value END AS value",
        f"CASE WHEN event_type = 'error' THEN NULL WHEN {unchanged} THEN 'u' ELSE 't' END AS props__kind",
        f"CASE WHEN event_type <> 'error' AND NOT {unchanged} THEN props END AS props",
    )


def chg_ctl(changes: DataFrame) -> DataFrame:
    """The same log with begin and commit rows per touched relation; the last transaction
    has no commit."""
    last = changes.agg(F.max("xid").alias("xid"))
    per_tx = changes.groupBy("relation_oid", "xid", "final_lsn").agg(
        F.min("lsn").alias("lo"), F.max("lsn").alias("hi")
    )
    none = "CAST(NULL AS BIGINT)"
    begins = per_tx.selectExpr(
        "relation_oid", "lo * 10 - 1 AS pos", "'begin' AS msg_type", "xid", "final_lsn", f"{none} AS k"
    )
    rows = changes.selectExpr(
        "relation_oid",
        "lsn * 10 AS pos",
        "CASE op WHEN 'I' THEN 'insert' WHEN 'U' THEN 'update' ELSE 'delete' END AS msg_type",
        f"{none} AS xid",
        f"{none} AS final_lsn",
        "k",
    )
    commits = per_tx.join(last, "xid", "left_anti").selectExpr(
        "relation_oid", "hi * 10 + 1 AS pos", "'commit' AS msg_type", f"{none} AS xid", f"{none} AS final_lsn", f"{none} AS k"
    )
    return begins.unionByName(rows).unionByName(commits)


def base(changes: DataFrame) -> DataFrame:
    """A snapshot position per relation, at a share of the log, always the end of a transaction."""
    last = changes.agg(F.max("final_lsn").alias("last"))
    share = F.expr("last * (relation_oid - 16383) div 5")
    return (
        changes.select("relation_oid").distinct().join(F.broadcast(last))
        .select("relation_oid", (share - share % 8).alias("start_lsn"))
    )


def at_share(changes: DataFrame, fifths: int):
    """The transaction end at so many fifths of the log, to compare positions with."""
    last = changes.agg(F.max("final_lsn")).first()[0] or 0
    return F.lit(last * fifths // 5 // 8 * 8)


def chg_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-identity log as signed rows."""
    ev = _with_previous_type(spark, sf_dir).withColumn("g", F.col("user_id") % 7)
    plus = F.when(
        F.col("event_type") != "error", F.struct(F.col("event_type").alias("t"), F.lit(1).cast("bigint").alias("w"))
    )
    minus = F.when(
        F.col("prev_type") != "error", F.struct(F.col("prev_type").alias("t"), F.lit(-1).cast("bigint").alias("w"))
    )
    sides = F.filter(F.array(plus, minus), lambda s: s.isNotNull())
    return ev.select("g", (F.col("event_id") + 1).alias("lsn"), F.inline(sides))


def _above_average(rows: DataFrame, key: str) -> DataFrame:
    """Keys that have at least as many rows as keys have on average."""
    counts = rows.groupBy(F.col(key).alias("oid")).agg(F.count("*").alias("n"))
    mean = counts.agg(F.avg("n").alias("mean"))
    return counts.join(F.broadcast(mean), F.col("n") >= F.col("mean")).select("oid")


def catalog(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Catalog stand-ins: ordinary tables, namespaces, publication members, primary keys."""
    nation = table(spark, sf_dir, "nation")
    codes = F.element_at(F.array(*[F.lit(c) for c in "dnif"]), (F.col("n_nationkey") % 4 + 1).cast("int"))
    return {
        "tables": nation.select(
            F.col("n_nationkey").alias("oid"),
            F.col("n_name").alias("relname"),
            F.col("n_regionkey").alias("namespace_oid"),
            F.lit("r").alias("kind"),
            codes.alias("replica_identity"),
        ),
        "namespaces": table(spark, sf_dir, "region").select(
            F.col("r_regionkey").alias("oid"), F.col("r_name").alias("nspname")
        ),
        "published": _above_average(table(spark, sf_dir, "customer"), "c_nationkey").select("oid", F.lit("pub").alias("pubname")),
        "primary_keys": _above_average(table(spark, sf_dir, "supplier"), "s_nationkey"),
    }


def renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relation messages whose name changes over time."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("relation_oid"),
        (F.col("o_orderkey") + 1).alias("lsn"),
        F.lit("public").alias("namespace"),
        F.col("o_orderpriority").alias("name"),
    )


def orders_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A changed copy of three columns of ``orders``."""
    return (
        table(spark, sf_dir, "orders")
        .where("o_orderkey % 101 <> 0")
        .select(
            "o_orderkey",
            "o_custkey",
            F.when(F.col("o_orderkey") % 97 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        )
    )


def moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key-changing updates with an unchanged status, then re-inserts of left keys."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    key = F.col("o_orderkey")
    none = F.lit(None)

    def step(rows: DataFrame, shift: int, op: str, k, old, kind: str, status) -> DataFrame:
        return rows.select(
            (F.lit(shift) + key).cast("bigint").alias("pos"),
            F.lit(op).alias("op"),
            k.cast("bigint").alias("k"),
            old.cast("bigint").alias("old_k"),
            F.lit(kind).alias("status__kind"),
            status.cast("string").alias("status"),
        )

    tens, twenties, forties = (orders.where(key % m == 0) for m in (10, 20, 40))
    return (
        step(orders, 0, "I", key, none, "t", F.col("o_orderstatus"))
        .unionByName(step(tens, 100000000, "U", key + 10000000, key, "u", none))
        .unionByName(step(twenties, 200000000, "U", key + 20000000, key + 10000000, "u", none))
        .unionByName(step(forties, 300000000, "I", key, none, "t", F.lit("R")))
    )


def micros(column: str):
    return as_micros(F.col(column))


# The layout of the fixture tables.
CHG_COLUMNS = [
    {"is_key": True, "name": "k", "type_oid": 20, "typmod": -1},
    {"is_key": False, "name": "value", "type_oid": 701, "typmod": -1},
    {"is_key": False, "name": "props", "type_oid": 25, "typmod": -1},
]


def columns_literal(columns: list[dict]):
    return F.array(
        *[
            F.struct(
                F.lit(c["is_key"]).alias("is_key"),
                F.lit(c["name"]).alias("name"),
                F.lit(c["type_oid"]).cast("bigint").alias("type_oid"),
                F.lit(c["typmod"]).cast("int").alias("typmod"),
            )
            for c in columns
        ]
    )


def table_name(oid):
    return F.concat(F.lit("t"), oid.cast("string"))


def relations(changes: DataFrame) -> DataFrame:
    """One schema version per relation of ``chg``."""
    return changes.groupBy("relation_oid").agg(F.min("lsn").alias("lsn")).select(
        "relation_oid",
        "lsn",
        F.when(F.col("relation_oid") % 2 == 0, "public").otherwise("app").alias("namespace"),
        table_name(F.col("relation_oid")).alias("name"),
        F.lit("d").alias("replica_identity"),
        columns_literal(CHG_COLUMNS).alias("columns"),
    )


def messages(changes: DataFrame) -> DataFrame:
    """``chg`` as canonical messages: relation, begin, insert, update, delete, commit.

    Headers come with begin only; the last transaction has no commit. Positions leave room
    between changes for the control messages."""
    from tidelog.functions.cells import cell, text_cell
    from tidelog.schema import CHANGES

    def cast_all(df: DataFrame) -> DataFrame:
        have = set(df.columns)
        return df.select(
            *[
                (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
                for f in CHANGES.fields
            ]
        )

    null_cell = cell(F.lit("n"), F.lit(None))
    row = F.array(
        text_cell(F.col("k")),
        cell(F.col("value__kind"), F.col("value").cast("decimal(18,2)")),
        cell(F.col("props__kind"), F.col("props")),
    )
    rows = changes.select(
        "relation_oid",
        (F.col("lsn") * 100).alias("pos"),
        F.when(F.col("op") == "I", "insert").when(F.col("op") == "U", "update").otherwise("delete").alias("msg_type"),
        F.when(F.col("op") == "D", F.array(text_cell(F.col("k")), null_cell, null_cell)).alias("ident"),
        F.when(F.col("op") == "D", F.lit(True)).alias("ident_is_key"),
        F.when(F.col("op") != "D", row).alias("new_row"),
    )
    per_tx = changes.groupBy("relation_oid", "xid", "final_lsn").agg(
        F.min("lsn").alias("lo"), F.max("lsn").alias("hi"), F.max("ts").alias("commit_ts")
    )
    begins = per_tx.select(
        "relation_oid", (F.col("lo") * 100 - 40).alias("pos"), F.lit("begin").alias("msg_type"), "xid", "final_lsn", "commit_ts"
    )
    last = changes.agg(F.max("xid").alias("__last"))
    commits = per_tx.join(last, F.col("xid") == F.col("__last"), "left_anti").select(
        "relation_oid",
        (F.col("hi") * 100 + 50).alias("pos"),
        F.lit("commit").alias("msg_type"),
        F.col("final_lsn").alias("commit_lsn"),
        (F.col("final_lsn") + 1).alias("end_lsn"),
        F.lit(0).alias("flags"),
        "commit_ts",
    )
    schemas = relations(changes).select(
        "relation_oid",
        (F.col("lsn") * 100 - 20).alias("pos"),
        F.lit("relation").alias("msg_type"),
        "namespace",
        "name",
        "replica_identity",
        "columns",
    )
    out = cast_all(rows)
    for other in (begins, commits, schemas):
        out = out.unionByName(cast_all(other))
    return out


def with_raw(log: DataFrame) -> DataFrame:
    """Canonical messages with their binary form in ``raw``."""
    from tidelog.fixtures import wire

    ts = F.unix_micros("commit_ts")
    oid, kind = F.col("relation_oid"), F.col("msg_type")
    raw = (
        F.when(kind == "begin", wire.begin(F.col("final_lsn"), ts, F.col("xid")))
        .when(kind == "commit", wire.commit(F.col("commit_lsn"), F.col("end_lsn"), ts))
        .when(kind == "insert", wire.insert(oid, F.col("new_row")))
        .when(kind == "update", wire.update(oid, F.col("ident"), F.col("ident_is_key"), F.col("new_row")))
        .when(kind == "delete", wire.delete(oid, F.col("ident"), F.col("ident_is_key")))
        .when(
            kind == "relation",
            wire.relation(oid, F.col("namespace"), F.col("name"), F.col("replica_identity"), F.col("columns")),
        )
    )
    return log.withColumn("raw", raw)


def order_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Update messages over ``orders``: without identity, with the key, with the whole old row."""
    from tidelog.functions.cells import cell

    key = F.col("o_orderkey")
    none = F.lit(None)
    status = cell(F.when(F.col("o_orderstatus") == "P", "n").otherwise("t"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")))
    priority = cell(F.when(key % 5 == 0, "u").otherwise("t"), F.when(key % 5 != 0, F.col("o_orderpriority")))
    null_cell = cell(F.lit("n"), none)
    by_key = F.array(cell(F.lit("t"), key + 1000000), null_cell, null_cell)
    whole = F.array(cell(F.lit("t"), key), status, cell(F.lit("t"), F.col("o_orderpriority")))
    return table(spark, sf_dir, "orders").select(
        F.lit(20001).cast("bigint").alias("relation_oid"),
        key.alias("pos"),
        F.lit("update").alias("msg_type"),
        F.when(key % 3 == 1, by_key).when(key % 3 == 2, whole).alias("ident"),
        F.when(key % 3 == 1, F.lit(True)).when(key % 3 == 2, F.lit(False)).alias("ident_is_key"),
        F.array(cell(F.lit("t"), key), status, priority).alias("new_row"),
        F.lit("public").alias("namespace"),
        F.lit("orders").alias("name"),
        columns_literal(ORDER_COLUMNS).alias("columns"),
    )


# The layout of the order fixture.
ORDER_COLUMNS = [
    {"is_key": True, "name": "o_orderkey", "type_oid": 20, "typmod": -1},
    {"is_key": False, "name": "o_orderstatus", "type_oid": 25, "typmod": -1},
    {"is_key": False, "name": "o_orderpriority", "type_oid": 25, "typmod": -1},
]


def schema_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Old and new schema per supplier: unchanged, reordered, or altered, dropped and added
    columns; some change their identity or name."""

    def c(name: str, type_oid: int, is_key: bool = False) -> dict:
        return {"is_key": is_key, "name": name, "type_oid": type_oid, "typmod": -1}

    old_columns = [c("id", 23, True), c("value", 23), c("hash", 25)]
    altered = [c("id", 23, True), c("value", 20), c("note", 25), c("extra", 16)]
    reordered = [c("id", 23, True), c("hash", 25), c("value", 23)]
    key, group = F.col("s_suppkey"), F.col("s_nationkey")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    name = F.concat(F.lit("s"), key.cast("string"))
    old = suppliers.select(
        key.alias("relation_oid"),
        F.lit("public").alias("namespace"),
        name.alias("name"),
        F.lit("d").alias("replica_identity"),
        columns_literal(old_columns).alias("columns"),
    )
    new = suppliers.select(
        key.alias("relation_oid"),
        F.lit("public").alias("namespace"),
        F.when(group % 7 == 0, F.concat(name, F.lit("_new"))).otherwise(name).alias("name"),
        F.when(key % 5 == 0, "f").otherwise("d").alias("replica_identity"),
        F.when(group % 3 == 0, columns_literal(altered))
        .when(group % 3 == 1, columns_literal(old_columns))
        .otherwise(columns_literal(reordered))
        .alias("columns"),
    )
    return old, new
