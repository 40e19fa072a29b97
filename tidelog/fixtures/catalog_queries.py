"""Queries over catalogs, names, schemas, cells and scalar conversions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.fixtures import tables as t
from tidelog.fixtures.oracles import with_fixtures
from tidelog.fixtures.registry import query
from tidelog.functions import cells, lsn, text, types
from tidelog.functions.lsn import as_micros
from tidelog.operators import catalog, render, replay, transactions

# --- publication and identity --------------------------------------------------------------


def publication(spark: SparkSession, sf: str) -> DataFrame:
    c = t.catalog(spark, sf)
    return catalog.publication_tables(c["tables"], c["namespaces"], c["published"], c["primary_keys"], "pub")


@query("publication_tables", with_fixtures("catalog", body="SELECT * FROM catalog"))
def publication_tables(spark: SparkSession, sf: str) -> DataFrame:
    return publication(spark, sf)


_TARGET = "CASE WHEN has_pk THEN 'd' WHEN replica_identity = 'i' THEN 'i' ELSE 'f' END"


@query(
    "target_identity",
    with_fixtures(
        "catalog",
        body=f"""SELECT oid, has_pk, replica_identity, {_TARGET} AS target_identity, {_TARGET} <> replica_identity AS must_change FROM catalog""",
    ),
)
def target_identity(spark: SparkSession, sf: str) -> DataFrame:
    out = catalog.target_identity(publication(spark, sf))
    return out.select("oid", "has_pk", "replica_identity", "target_identity", "must_change")


@query(
    "identity_names",
    """SELECT p_partkey, code, name, CASE name WHEN 'default' THEN 'd' WHEN 'index' THEN 'i' WHEN 'nothing' THEN 'n' ELSE 'f' END AS back
FROM (SELECT p_partkey, code, CASE code WHEN 'i' THEN 'index' WHEN 'n' THEN 'nothing' WHEN 'f' THEN 'full' ELSE 'default' END AS name
      FROM (SELECT p_partkey, substr('dinfx', CAST(p_size % 5 AS INTEGER) + 1, 1) AS code FROM part) c) n""",
)
def identity_names(spark: SparkSession, sf: str) -> DataFrame:
    code = F.substr(F.lit("dinfx"), F.col("p_size") % 5 + 1, F.lit(1))
    named = t.table(spark, sf, "part").select("p_partkey", code.alias("code"))
    named = named.withColumn("name", catalog.identity_name(F.col("code")))
    return named.withColumn("back", catalog.identity_code(F.col("name")))


# --- attributes and types ------------------------------------------------------------------


@query(
    "relation_columns",
    """SELECT a.conv_id AS relation_oid, a.turn AS attnum, a.role AS name, length(a.text) AS type_oid, -1 AS typmod,
       coalesce(list_contains(i.attnums, a.turn), false) AS is_key
FROM conversations a LEFT JOIN (SELECT conv_id, list(turn) AS attnums FROM conversations WHERE role = 'user' AND turn > 0 GROUP BY conv_id) i ON i.conv_id = a.conv_id
WHERE a.turn > 0 AND a.role <> 'system'""",
)
def relation_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of a conversation stand for the attributes of a relation; an index is small."""
    rows = t.table(spark, sf, "conversations")
    attributes = rows.select(
        F.col("conv_id").alias("relation_oid"),
        F.col("turn").alias("attnum"),
        F.col("role").alias("name"),
        F.length("text").alias("type_oid"),
        F.lit(-1).alias("typmod"),
        (F.col("role") == "system").alias("is_dropped"),
    )
    index = (
        rows.where("role = 'user' and turn > 0")
        .groupBy(F.col("conv_id").alias("relation_oid"))
        .agg(F.collect_list("turn").alias("key_attnums"))
    )
    return catalog.relation_columns(attributes, index)


_TYPES = """(SELECT p_partkey AS oid, p_name AS typname, substr('bprec', CAST(p_size % 5 AS INTEGER) + 1, 1) AS typtype,
  CASE WHEN p_size % 3 = 0 THEN p_partkey - 1 ELSE -1 END AS typelem, p_partkey % 6 AS namespace_oid FROM part)"""
_SPACES = """(SELECT r_regionkey AS oid, CASE r_regionkey WHEN 0 THEN 'pg_catalog' WHEN 1 THEN 'public' ELSE r_name END AS nspname FROM region)"""


def _types(spark: SparkSession, sf: str) -> DataFrame:
    return t.table(spark, sf, "part").select(
        F.col("p_partkey").alias("oid"),
        F.col("p_name").alias("typname"),
        F.substr(F.lit("bprec"), F.col("p_size") % 5 + 1, F.lit(1)).alias("typtype"),
        F.when(F.col("p_size") % 3 == 0, F.col("p_partkey") - 1).otherwise(-1).alias("typelem"),
        (F.col("p_partkey") % 6).alias("namespace_oid"),
    )


def _spaces(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("r_regionkey")
    name = F.when(key == 0, "pg_catalog").when(key == 1, "public").otherwise(F.col("r_name"))
    return t.table(spark, sf, "region").select(key.alias("oid"), name.alias("nspname"))


@query(
    "type_catalog",
    f"""SELECT t.oid, CASE WHEN n.nspname IN ('pg_catalog', 'public') THEN t.typname ELSE n.nspname || '.' || t.typname END AS type_name
FROM {_TYPES} t LEFT JOIN {_TYPES} e ON t.typelem = e.oid LEFT JOIN {_SPACES} n ON t.namespace_oid = n.oid
WHERE t.typtype IN ('b', 'p', 'r', 'e') AND (e.oid IS NULL OR e.typtype IN ('b', 'p', 'r'))""",
)
def type_catalog(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.type_catalog(_types(spark, sf), _spaces(spark, sf))


@query(
    "enum_arrays",
    f"SELECT t.oid, t.typname FROM {_TYPES} t JOIN {_TYPES} e ON t.typelem = e.oid WHERE t.typtype = 'b' AND e.typtype = 'e'",
)
def enum_arrays(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.enum_arrays(_types(spark, sf))


# --- names ---------------------------------------------------------------------------------

_HISTORY = """(SELECT relation_oid, lsn, lead(lsn) OVER (PARTITION BY relation_oid ORDER BY lsn) AS next_lsn, name
FROM (SELECT *, lag(name) OVER (PARTITION BY relation_oid ORDER BY lsn) AS prev FROM renames) p WHERE prev IS NULL OR prev <> name)"""


@query("name_history", with_fixtures("renames", body=f"SELECT * FROM {_HISTORY} h"))
def name_history(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.name_changes(t.renames(spark, sf)).drop("namespace")


@query(
    "resolve_name_asof",
    with_fixtures(
        "renames",
        body=f"""SELECT r.c_custkey, r.name, r.at_lsn, arg_max(h.relation_oid, h.lsn) AS relation_oid, max(h.lsn) AS entry_lsn
FROM (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' WHEN 2 THEN '3-MEDIUM' WHEN 3 THEN '4-NOT SPECIFIED' ELSE '5-LOW' END AS name,
             c_custkey AS at_lsn FROM customer) r
LEFT JOIN {_HISTORY} h ON h.name = r.name AND (r.at_lsn = 0 OR h.lsn <= r.at_lsn)
GROUP BY r.c_custkey, r.name, r.at_lsn""",
    ),
)
def resolve_name_asof(spark: SparkSession, sf: str) -> DataFrame:
    """Every customer asks for a name at a position; position 0 means no bound."""
    names = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    requests = t.table(spark, sf, "customer").select(
        "c_custkey",
        F.lit("public").alias("namespace"),
        F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("c_custkey") % 5 + 1).cast("int")).alias("name"),
        F.col("c_custkey").alias("at_lsn"),
    )
    history = catalog.name_changes(t.renames(spark, sf))
    return catalog.resolve_name(history, requests).drop("namespace")


@query(
    "relation_lookup",
    with_fixtures("renames", body="SELECT relation_oid, max(lsn) AS lsn, name FROM renames WHERE name = '5-LOW' GROUP BY relation_oid, name"),
)
def relation_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.relation_for(t.renames(spark, sf), namespace="public", name="5-LOW").drop("namespace")


@query(
    "register_tables",
    with_fixtures(
        "renames",
        body="""SELECT relation_oid, min(lsn) AS lsn, arg_min(name, lsn) AS name FROM renames
WHERE relation_oid NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY relation_oid""",
    ),
)
def register_tables(spark: SparkSession, sf: str) -> DataFrame:
    known = t.table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("relation_oid"))
    return catalog.register_tables(t.renames(spark, sf), known).drop("namespace")


@query(
    "relation_versions",
    with_fixtures(
        "renames", body="SELECT relation_oid, lsn, name, lead(lsn) OVER (PARTITION BY relation_oid ORDER BY lsn) AS next_lsn FROM renames"
    ),
)
def relation_versions(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.relation_versions(t.renames(spark, sf)).drop("namespace")


# --- schema comparison ---------------------------------------------------------------------

_S = "(SELECT s_suppkey AS k, s_nationkey AS g, 's' || s_suppkey AS old_name, CASE WHEN s_nationkey % 7 = 0 THEN 's' || s_suppkey || '_new' ELSE 's' || s_suppkey END AS new_name FROM supplier)"


@query(
    "schema_mismatch",
    f"""SELECT k AS relation_oid, -1 AS ordinal, 'name' AS what FROM {_S} s WHERE old_name <> new_name
UNION ALL SELECT k, -1, 'identity' FROM {_S} s WHERE k % 5 = 0
UNION ALL SELECT k, o.i, 'column' FROM {_S} s JOIN (SELECT 1 AS i UNION ALL SELECT 2 UNION ALL SELECT 3) o ON true
WHERE (g % 3 = 0) OR (g % 3 = 2 AND o.i < 3)""",
)
def schema_mismatch(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.schema_mismatches(*t.schema_pair(spark, sf))


_DIFF_ROWS = f"""(SELECT k AS relation_oid, 'altered' AS change, 1 AS ordinal, 'value' AS old_value, 'value' AS new_value, 20 AS type_oid, -1 AS typmod FROM {_S} s WHERE g % 3 = 0
UNION ALL SELECT k, 'dropped', 2, 'hash', NULL, NULL, NULL FROM {_S} s WHERE g % 3 = 0
UNION ALL SELECT k, 'added', 2, 'note', 'note', 25, -1 FROM {_S} s WHERE g % 3 = 0
UNION ALL SELECT k, 'added', 3, 'extra', 'extra', 16, -1 FROM {_S} s WHERE g % 3 = 0
UNION ALL SELECT k, 'renamed', -1, old_name, new_name, NULL, NULL FROM {_S} s WHERE old_name <> new_name
UNION ALL SELECT k, 'identity', -1, 'd', 'f', NULL, NULL FROM {_S} s WHERE k % 5 = 0)"""


@query("schema_diff", f"SELECT * FROM {_DIFF_ROWS} d")
def schema_diff(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.schema_diff(*t.schema_pair(spark, sf))


@query(
    "render_ddl",
    f"""SELECT d.relation_oid, d.change, d.ordinal,
 CASE d.change WHEN 'dropped' THEN 'alter table "public"."' || s.new_name || '" drop column "' || d.old_value || '";'
  WHEN 'added' THEN 'do $_$begin execute ''alter table "public"."' || s.new_name || '" add column "' || d.new_value || '" '' || format_type(' || d.type_oid || ', NULL); end$_$;'
  WHEN 'altered' THEN 'do $_$begin execute ''alter table "public"."' || s.new_name || '" alter column "' || d.old_value || '" type '' || format_type(' || d.type_oid || ', NULL); end$_$;'
  WHEN 'renamed' THEN 'alter table "public"."' || d.old_value || '" rename to "' || d.new_value || '";'
  ELSE 'alter table "public"."' || s.new_name || '" replica identity full;' END AS sql
FROM {_DIFF_ROWS} d JOIN {_S} s ON s.k = d.relation_oid""",
)
def render_ddl(spark: SparkSession, sf: str) -> DataFrame:
    old, new = t.schema_pair(spark, sf)
    return render.render_ddl(catalog.schema_diff(old, new), new)


@query(
    "key_columns",
    "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name ELSE '' END || CASE WHEN p_size % 6 = 0 THEN ',' ELSE '' END || CASE WHEN p_size % 3 = 0 THEN p_brand ELSE '' END AS keys FROM part",
)
def key_columns(spark: SparkSession, sf: str) -> DataFrame:
    def column(name: str, every: int):
        return F.struct(
            (F.col("p_size") % every == 0).alias("is_key"),
            F.col(name).alias("name"),
            F.lit(25).cast("bigint").alias("type_oid"),
            F.lit(-1).alias("typmod"),
        )

    columns = F.array(column("p_name", 2), column("p_brand", 3))
    return t.table(spark, sf, "part").select(
        "p_partkey", F.array_join(cells.key_names(columns), ",").alias("keys")
    )


# --- cells and rendering -------------------------------------------------------------------

_OU = """(SELECT o_orderkey AS pos, o_orderkey % 3 AS variant, o_orderstatus AS status, o_orderpriority AS priority, o_orderstatus = 'P' AS status_null, o_orderkey % 5 = 0 AS unchanged FROM orders)"""


@query(
    "cell_kinds",
    f"""SELECT pos, 'text' AS key_kind, CASE WHEN status_null THEN 'null' ELSE 'text' END AS status_kind,
 CASE WHEN unchanged THEN 'unchanged' ELSE 'text' END AS priority_kind, unchanged AS is_unchanged, status_null AS is_null, true AS is_text FROM {_OU} o""",
)
def cell_kinds(spark: SparkSession, sf: str) -> DataFrame:
    key, status, priority = (F.get("new_row", F.lit(i)) for i in range(3))
    return t.order_updates(spark, sf).select(
        "pos",
        cells.kind_name(key).alias("key_kind"),
        cells.kind_name(status).alias("status_kind"),
        cells.kind_name(priority).alias("priority_kind"),
        cells.is_unchanged(priority).alias("is_unchanged"),
        cells.is_null(status).alias("is_null"),
        cells.is_text(key).alias("is_text"),
    )


@query(
    "tuple_long",
    f"""SELECT pos, 0 AS ordinal, 'o_orderkey' AS name, true AS is_key, 20 AS type_oid, 't' AS kind, CAST(pos AS VARCHAR) AS value FROM {_OU} o
UNION ALL SELECT pos, 1, 'o_orderstatus', false, 25, CASE WHEN status_null THEN 'n' ELSE 't' END, CASE WHEN status_null THEN NULL ELSE status END FROM {_OU} o
UNION ALL SELECT pos, 2, 'o_orderpriority', false, 25, CASE WHEN unchanged THEN 'u' ELSE 't' END, CASE WHEN unchanged THEN NULL ELSE priority END FROM {_OU} o""",
)
def tuple_long(spark: SparkSession, sf: str) -> DataFrame:
    return replay.tuple_long(t.order_updates(spark, sf), keep=["pos"])


_LOCATE = """CASE variant WHEN 0 THEN '"o_orderkey" = ''' || pos || '''' WHEN 1 THEN '"o_orderkey" = ''' || (pos + 1000000) || ''''
  ELSE '"o_orderkey" = ''' || pos || ''' and "o_orderstatus"' || CASE WHEN status_null THEN ' is null' ELSE ' = ''' || status || '''' END || ' and "o_orderpriority" = ''' || priority || '''' END"""


@query("locate_key", f"SELECT pos, replace(replace({_LOCATE}, '\"', ''), '''', '') AS located FROM {_OU} o")
def locate_key(spark: SparkSession, sf: str) -> DataFrame:
    found = cells.match_cells(F.col("ident"), F.col("ident_is_key"), F.col("new_row"), F.col("columns"))
    one = F.transform(
        found,
        lambda z: F.when(z["kind"] == "t", F.concat(z["name"], F.lit(" = "), z["value"])).otherwise(
            F.concat(z["name"], F.lit(" is null"))
        ),
    )
    return t.order_updates(spark, sf).select("pos", F.array_join(one, " and ").alias("located"))


def _rendered(spark: SparkSession, sf: str, msg_type: str) -> DataFrame:
    log = t.chg(spark, sf)
    rows = t.messages(log).where(F.col("msg_type") == msg_type)
    return render.render_dml(catalog.with_relation(rows, t.relations(log))).select("relation_oid", "pos", "sql")


_TABLE = """'"' || CASE WHEN relation_oid % 2 = 0 THEN 'public' ELSE 'app' END || '"."t' || relation_oid || '"'"""
_VALUE = "CASE WHEN value_kind = 'n' THEN 'null' ELSE '''' || CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) || '''' END"
_PROPS = "'''' || replace(props, '''', '''''') || ''''"


@query(
    "render_insert",
    with_fixtures(
        "chg",
        body=f"""SELECT relation_oid, lsn * 100 AS pos, 'insert into ' || {_TABLE} || ' ("k", "value", "props") values (''' || k || ''', ' || {_VALUE} || ', ' || {_PROPS} || ');' AS sql
FROM chg WHERE op = 'I'""",
    ),
)
def render_insert(spark: SparkSession, sf: str) -> DataFrame:
    return _rendered(spark, sf, "insert")


@query(
    "render_update",
    with_fixtures(
        "chg",
        body=f"""SELECT relation_oid, lsn * 100 AS pos, 'update ' || {_TABLE} || ' set "k" = ''' || k || ''', "value" = ' || {_VALUE}
 || CASE WHEN props_kind = 'u' THEN '' ELSE ', "props" = ' || {_PROPS} END || ' where "k" = ''' || k || ''';' AS sql
FROM chg WHERE op = 'U'
UNION ALL SELECT 20001, pos, 'update "public"."orders" set "o_orderkey" = ''' || pos || ''', "o_orderstatus" = ' || CASE WHEN status_null THEN 'null' ELSE '''' || status || '''' END
 || CASE WHEN unchanged THEN '' ELSE ', "o_orderpriority" = ''' || priority || '''' END || ' where ' || {_LOCATE} || ';' FROM {_OU} o""",
    ),
)
def render_update(spark: SparkSession, sf: str) -> DataFrame:
    orders = render.render_dml(t.order_updates(spark, sf)).select("relation_oid", "pos", "sql")
    return _rendered(spark, sf, "update").unionByName(orders)


@query(
    "render_delete",
    with_fixtures(
        "chg",
        body=f"""SELECT relation_oid, lsn * 100 AS pos, 'delete from ' || {_TABLE} || ' where "k" = ''' || k || ''';' AS sql FROM chg WHERE op = 'D'""",
    ),
)
def render_delete(spark: SparkSession, sf: str) -> DataFrame:
    return _rendered(spark, sf, "delete")


_TIME = "strftime(make_timestamp({us}), '%Y-%m-%dT%H:%M:%SZ')"
_LSN = "printf('%X', {x} >> 32) || '/' || printf('%X', {x} & 4294967295)"
_CELLS = f"'[''' || k || ''', ' || CASE WHEN value_kind = 'n' THEN 'null' ELSE '''' || value || '''' END || ', ' || CASE WHEN props_kind = 'u' THEN '[unchanged value]' ELSE {_PROPS} END || ']'"
INSPECT_SQL = f"""SELECT relation_oid, pos, rpad(msg_type || ':', 10, ' ') || ' ' ||
 CASE msg_type WHEN 'begin' THEN 'FinalLSN:' || {_LSN.format(x='final_lsn')} || ' Timestamp:' || {_TIME.format(us='commit_us')} || ' XID:' || xid
  WHEN 'commit' THEN 'LSN:' || {_LSN.format(x='final_lsn')} || ' Timestamp:' || {_TIME.format(us='own_us')} || ' TxEndLSN:' || {_LSN.format(x='(final_lsn + 1)')}
  WHEN 'insert' THEN 'relOID:' || relation_oid || ' newValues: ' || {_CELLS}
  WHEN 'update' THEN 'relOID:' || relation_oid || ' newValues: ' || {_CELLS}
  WHEN 'delete' THEN 'relOID:' || relation_oid || ' key: [''' || k || ''', null, null]'
  ELSE 'OID:' || relation_oid || ' Name:' || CASE WHEN relation_oid % 2 = 0 THEN '' ELSE 'app.' END || 't' || relation_oid || ' RepIdentity:default Columns:["k" (type:20) key, "value" (type:701), "props" (type:25)]' END AS line
FROM messages"""


@query("inspect_lines", with_fixtures("messages", body=INSPECT_SQL))
def inspect_lines(spark: SparkSession, sf: str) -> DataFrame:
    return render.inspect(t.messages(t.chg(spark, sf))).select("relation_oid", "pos", "line")


@query(
    "display_name",
    """SELECT n_nationkey, CASE WHEN r_regionkey = 0 THEN n_name ELSE r_name || '.' || n_name END AS display_name,
 CASE WHEN r_regionkey = 0 THEN n_name ELSE r_name || '.' || n_name END || ' (OID: ' || n_nationkey || ') Columns: k(20), value(701), props(25)' AS structure
FROM nation JOIN region ON r_regionkey = n_regionkey""",
)
def display_name(spark: SparkSession, sf: str) -> DataFrame:
    nations = t.table(spark, sf, "nation").join(
        t.table(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey")
    )
    space = F.when(F.col("r_regionkey") == 0, "public").otherwise(F.col("r_name"))
    return nations.select(
        "n_nationkey",
        render.display_name(space, F.col("n_name")).alias("display_name"),
        render.structure(F.col("n_nationkey"), space, F.col("n_name"), t.columns_literal(t.CHG_COLUMNS)).alias("structure"),
    )


@query(
    "quote_literal",
    """SELECT doc_id, CASE WHEN contains(body, '\\') THEN 'E''' || body || '''' ELSE '''' || body || '''' END AS literal,
 '"' || replace(source, '"', '""') || '"' AS identifier
FROM (SELECT doc_id, source, replace(replace(replace(replace(replace(text, '\\', '\\\\'), chr(9), '\\t'), chr(13), '\\r'), chr(10), '\\n'), '''', '''''') AS body FROM documents) d""",
)
def quote_literal(spark: SparkSession, sf: str) -> DataFrame:
    return t.table(spark, sf, "documents").select(
        "doc_id",
        text.quote_literal(F.col("text")).alias("literal"),
        text.quote_ident(F.col("source")).alias("identifier"),
    )


@query(
    "truncate_fanout",
    """SELECT o_orderkey AS pos, o_custkey AS relation_oid FROM orders UNION ALL SELECT o_orderkey, o_custkey + 1 FROM orders WHERE o_orderstatus = 'P'""",
)
def truncate_fanout(spark: SparkSession, sf: str) -> DataFrame:
    one = F.array("o_custkey")
    both = F.array(F.col("o_custkey"), F.col("o_custkey") + 1)
    log = t.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("pos"),
        F.lit("truncate").alias("msg_type"),
        F.when(F.col("o_orderstatus") == "P", both).otherwise(one).alias("relation_oids"),
    )
    return transactions.explode_truncate(log).select("pos", "relation_oid")


# --- scalars -------------------------------------------------------------------------------


@query(
    "lsn_text",
    f"""SELECT l AS lsn, {_LSN.format(x='l')} AS as_text, l AS back, lower(lpad(printf('%x', l), 16, '0')) AS hex, l <> 0 AS valid
FROM (SELECT o_orderkey * 7919000003 AS l FROM orders) o""",
)
def lsn_text(spark: SparkSession, sf: str) -> DataFrame:
    value = F.col("o_orderkey") * F.lit(7919000003)
    rows = t.table(spark, sf, "orders").select(value.alias("lsn"))
    rows = rows.withColumn("as_text", lsn.lsn_format(F.col("lsn")))
    return rows.select(
        "lsn",
        "as_text",
        lsn.lsn_parse(F.col("as_text")).alias("back"),
        lsn.lsn_hex(F.col("lsn")).alias("hex"),
        lsn.lsn_valid(F.col("lsn")).alias("valid"),
    )


@query(
    "segment_names",
    """SELECT event_id, lower(lpad(printf('%x', event_id), 16, '0')) || CASE WHEN user_id % 12 = 0 THEN '' ELSE '.' || (user_id % 12) END AS name,
 event_id AS min_lsn, user_id % 12 AS postfix FROM events""",
)
def segment_names(spark: SparkSession, sf: str) -> DataFrame:
    rows = t.table(spark, sf, "events").select(
        "event_id", lsn.segment_name(F.col("event_id"), F.col("user_id") % 12).alias("name")
    )
    return rows.select(
        "event_id",
        "name",
        lsn.segment_lsn(F.col("name")).alias("min_lsn"),
        lsn.segment_postfix_of(F.col("name")).alias("postfix"),
    )


@query(
    "shard_path",
    """SELECT oid, substr(h, 7, 2) || '/' || substr(h, 5, 2) || '/' || substr(h, 3, 2) || '/' || oid AS path
FROM (SELECT oid, lower(lpad(printf('%x', oid), 8, '0')) AS h FROM (SELECT c_custkey * 2654 + 16384 AS oid FROM customer) c) d""",
)
def shard_path(spark: SparkSession, sf: str) -> DataFrame:
    rows = t.table(spark, sf, "customer").select((F.col("c_custkey") * 2654 + 16384).alias("oid"))
    return rows.withColumn("path", lsn.shard_path(F.col("oid")))


@query("pg_timestamp", "SELECT event_id, epoch_us(ts) AS back_us FROM events")
def pg_timestamp(spark: SparkSession, sf: str) -> DataFrame:
    since_2000 = as_micros(F.col("ts")) - F.lit(lsn.EPOCH_2000_MICROS)
    return t.table(spark, sf, "events").select(
        "event_id", F.unix_micros(lsn.pg_timestamp(since_2000)).alias("back_us")
    )


@query(
    "typed_projection",
    """SELECT l_orderkey, l_linenumber, l_quantity, CAST(l_extendedprice AS DECIMAL(18,2)) AS l_extendedprice, l_returnflag = 'A' AS l_returned,
 epoch_us(l_shipdate) AS ship_us, l_linestatus, 0 AS cast_errors FROM lineitem""",
)
def typed_projection(spark: SparkSession, sf: str) -> DataFrame:
    """Columns as the log carries them, text, and back to their types."""
    as_text = t.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("l_orderkey"),
        F.col("l_linenumber").cast("string").alias("l_linenumber"),
        F.col("l_quantity").cast("string").alias("l_quantity"),
        F.col("l_extendedprice").cast("decimal(18,2)").cast("string").alias("l_extendedprice"),
        F.when(F.col("l_returnflag") == "A", "t").otherwise("f").alias("l_returned"),
        F.col("l_shipdate").cast("string").alias("ship"),
        "l_linestatus",
    )
    numeric_18_2 = ((18 << 16) | 2) + 4
    columns = [
        {"name": "l_orderkey", "type_oid": types.INT8, "typmod": -1},
        {"name": "l_linenumber", "type_oid": types.INT4, "typmod": -1},
        {"name": "l_quantity", "type_oid": types.FLOAT8, "typmod": -1},
        {"name": "l_extendedprice", "type_oid": types.NUMERIC, "typmod": numeric_18_2},
        {"name": "l_returned", "type_oid": types.BOOL, "typmod": -1},
        {"name": "ship", "type_oid": types.TIMESTAMP, "typmod": -1},
        {"name": "l_linestatus", "type_oid": types.TEXT, "typmod": -1},
    ]
    out = types.typed(as_text, columns)
    return out.withColumn("ship_us", as_micros(F.col("ship"))).drop("ship")
