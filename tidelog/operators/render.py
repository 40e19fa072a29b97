"""Changes as SQL text and as lines for inspection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.cells import match_cells, zip_columns
from tidelog.functions.lsn import lsn_format
from tidelog.functions.text import quote_ident, quote_literal, quote_name
from tidelog.operators.catalog import identity_name
from tidelog.schema import NULL_CELL, TEXT_CELL, UNCHANGED_CELL


def cell_text(cell: Column) -> Column:
    return (
        F.when(cell["kind"] == TEXT_CELL, quote_literal(cell["value"]))
        .when(cell["kind"] == NULL_CELL, F.lit("null"))
        .when(cell["kind"] == UNCHANGED_CELL, F.lit("[unchanged value]"))
        .otherwise(F.lit("unknown"))
    )


def _sent(columns: Column, cells: Column) -> Column:
    return F.filter(zip_columns(columns, cells), lambda z: z["kind"].isin(TEXT_CELL, NULL_CELL))


def _join(items: Column, separator: str, render) -> Column:
    return F.array_join(F.transform(items, render), separator)


def _conditions(cells: Column) -> Column:
    return _join(
        cells,
        " and ",
        lambda z: F.when(z["kind"] == TEXT_CELL, F.concat(quote_ident(z["name"]), F.lit(" = "), quote_literal(z["value"])))
        .otherwise(F.concat(quote_ident(z["name"]), F.lit(" is null"))),
    )


def insert_sql() -> Column:
    sent = _sent(F.col("columns"), F.col("new_row"))
    return F.concat(
        F.lit("insert into "),
        quote_name(F.col("namespace"), F.col("name")),
        F.lit(" ("),
        _join(sent, ", ", lambda z: quote_ident(z["name"])),
        F.lit(") values ("),
        _join(sent, ", ", cell_text),
        F.lit(");"),
    )


def update_sql() -> Column:
    """Null where nothing locates the row: such an update must not touch every row."""
    sent = _sent(F.col("columns"), F.col("new_row"))
    located = match_cells(F.col("ident"), F.col("ident_is_key"), F.col("new_row"), F.col("columns"))
    text = F.concat(
        F.lit("update "),
        quote_name(F.col("namespace"), F.col("name")),
        F.lit(" set "),
        _join(sent, ", ", lambda z: F.concat(quote_ident(z["name"]), F.lit(" = "), cell_text(z))),
        F.lit(" where "),
        _conditions(located),
        F.lit(";"),
    )
    return F.when((F.size(located) > 0) & (F.size(sent) > 0), text)


def delete_sql() -> Column:
    located = match_cells(F.col("ident"), F.col("ident_is_key"), F.col("ident"), F.col("columns"))
    text = F.concat(
        F.lit("delete from "),
        quote_name(F.col("namespace"), F.col("name")),
        F.lit(" where "),
        _conditions(located),
        F.lit(";"),
    )
    return F.when(F.size(located) > 0, text)


def render_dml(changes: DataFrame) -> DataFrame:
    """Add ``sql`` to insert, update and delete messages that carry their relation's
    ``namespace``, ``name`` and ``columns`` (see ``with_relation``)."""
    sql = (
        F.when(F.col("msg_type") == "insert", insert_sql())
        .when(F.col("msg_type") == "update", update_sql())
        .when(F.col("msg_type") == "delete", delete_sql())
    )
    return changes.where(F.col("msg_type").isin("insert", "update", "delete")).withColumn("sql", sql)


def render_ddl(diff: DataFrame, relations: DataFrame) -> DataFrame:
    """One statement per schema difference; ``relations`` are the new versions."""
    joined = diff.join(relations.select("relation_oid", "namespace", "name"), "relation_oid")
    table = quote_name(F.col("namespace"), F.col("name"))
    column = quote_ident(F.coalesce("new_value", "old_value"))
    modifier = F.when(F.col("typmod") > 0, F.col("typmod").cast("string")).otherwise(F.lit("NULL"))
    type_call = F.concat(
        F.lit(" ' || format_type("), F.col("type_oid").cast("string"), F.lit(", "), modifier, F.lit("); end$_$;")
    )

    def in_quotes(text: Column) -> Column:
        return F.replace(text, F.lit("'"), F.lit("''"))

    def block(action: str, tail: str = "") -> Column:
        head = in_quotes(F.concat(F.lit("alter table "), table, F.lit(action), column, F.lit(tail)))
        return F.concat(F.lit("do $_$begin execute '"), head, type_call)

    def plain(*parts: Column) -> Column:
        return F.concat(F.lit("alter table "), table, *parts, F.lit(";"))

    old_table = quote_name(F.col("namespace"), F.col("old_value"))
    statement = (
        F.when(F.col("change") == "dropped", plain(F.lit(" drop column "), column))
        .when(F.col("change") == "added", block(" add column "))
        .when(F.col("change") == "altered", block(" alter column ", " type"))
        .when(F.col("change") == "identity", plain(F.lit(" replica identity "), identity_name(F.col("new_value"))))
        .when(
            F.col("change") == "renamed",
            F.concat(F.lit("alter table "), old_table, F.lit(" rename to "), quote_ident(F.col("new_value")), F.lit(";")),
        )
    )
    return joined.select("relation_oid", "change", "ordinal", statement.alias("sql"))


def display_name(namespace: Column, name: Column) -> Column:
    return F.when(namespace == "public", name).otherwise(F.concat_ws(".", namespace, name))


def structure(relation_oid: Column, namespace: Column, name: Column, columns: Column) -> Column:
    head = F.concat(display_name(namespace, name), F.lit(" (OID: "), relation_oid.cast("string"), F.lit(")"))
    listed = _join(columns, ", ", lambda c: F.concat(c["name"], F.lit("("), c["type_oid"].cast("string"), F.lit(")")))
    return F.when(F.size(columns) > 0, F.concat(head, F.lit(" Columns: "), listed)).otherwise(head)


def _time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _labelled(label: str, cells: Column) -> Column:
    return F.when(cells.isNotNull(), F.concat(F.lit(f"{label}: ["), _join(cells, ", ", cell_text), F.lit("]")))


def _column_line(c: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(F.replace(c["name"], F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.concat(
        quoted,
        F.lit(" (type:"),
        c["type_oid"].cast("string"),
        F.lit(")"),
        F.when(c["is_key"], F.lit(" key")).otherwise(F.lit("")),
        F.when(c["typmod"] != -1, F.concat(F.lit(" atttypmod:"), c["typmod"].cast("string"))).otherwise(F.lit("")),
    )


def message_text() -> Column:
    """Fields of a decoded message as one line of text."""
    rel = F.concat(F.lit("relOID:"), F.col("relation_oid").cast("string"))
    new = _labelled("newValues", F.col("new_row"))
    old = F.when(F.col("ident_is_key"), _labelled("key", F.col("ident"))).otherwise(
        _labelled("oldValues", F.col("ident"))
    )
    ts = F.concat(F.lit("Timestamp:"), _time(F.col("commit_ts")))
    named = F.concat(F.lit("Name:"), display_name(F.col("namespace"), F.col("name")))
    oids = F.when(
        F.size("relation_oids") > 0,
        F.concat(F.lit("tableOids:["), F.array_join(F.transform("relation_oids", lambda o: o.cast("string")), ", "), F.lit("]")),
    )
    kind = F.col("msg_type")
    return (
        F.when(kind == "insert", F.concat_ws(" ", rel, new))
        .when(kind == "update", F.concat_ws(" ", rel, new, old))
        .when(kind == "delete", F.concat_ws(" ", rel, old))
        .when(
            kind == "begin",
            F.concat_ws(" ", F.concat(F.lit("FinalLSN:"), lsn_format(F.col("final_lsn"))), ts, F.concat(F.lit("XID:"), F.col("xid").cast("string"))),
        )
        .when(
            kind == "commit",
            F.concat_ws(" ", F.concat(F.lit("LSN:"), lsn_format(F.col("commit_lsn"))), ts, F.concat(F.lit("TxEndLSN:"), lsn_format(F.col("end_lsn")))),
        )
        .when(kind == "origin", F.concat_ws(" ", F.concat(F.lit("LSN:"), lsn_format(F.col("origin_lsn"))), F.concat(F.lit("Name:"), F.col("name"))))
        .when(kind == "type", F.concat_ws(" ", F.concat(F.lit("OID:"), F.col("type_oid").cast("string")), named))
        .when(
            kind == "truncate",
            F.concat_ws(
                " ",
                F.when(F.col("cascade"), F.lit("cascade")),
                F.when(F.col("restart_identity"), F.lit("restart_identity")),
                oids,
            ),
        )
        .when(
            kind == "relation",
            F.concat_ws(
                " ",
                F.concat(F.lit("OID:"), F.col("relation_oid").cast("string")),
                named,
                F.concat(F.lit("RepIdentity:"), identity_name(F.col("replica_identity"))),
                F.concat(F.lit("Columns:["), _join(F.col("columns"), ", ", _column_line), F.lit("]")),
            ),
        )
    )


def inspect(changes: DataFrame) -> DataFrame:
    """Add ``line``: message type, padded, and its fields."""
    label = F.rpad(F.concat(F.col("msg_type"), F.lit(":")), 10, " ")
    return changes.withColumn("line", F.concat_ws(" ", label, message_text()))
