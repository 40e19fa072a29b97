"""Relations, names, schema versions and catalog queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.operators.lookup import join_small
from tidelog.operators.scan import Prev, asof_join, ordered_scan

MAX_LSN = 9223372036854775807
# Replica identity codes and names.
IDENTITIES = {"d": "default", "i": "index", "n": "nothing", "f": "full"}
# Kinds of types in the type catalog (base, pseudo, range, enum).
_TYPE_KINDS = ("b", "p", "r", "e")
_ELEMENT_KINDS = ("b", "p", "r")


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def identity_name(code: Column) -> Column:
    """Spelled-out identity; an unknown code counts as the default one."""
    return F.coalesce(F.try_element_at(_map(IDENTITIES), code), F.lit(IDENTITIES["d"]))


def identity_code(name: Column) -> Column:
    code = F.try_element_at(_map({v: k for k, v in IDENTITIES.items()}), name)
    return F.coalesce(code, F.raise_error(F.concat(F.lit("unknown replica identity: "), name)).cast("string"))


def target_identity(tables: DataFrame) -> DataFrame:
    """Identity each table should have: its primary key, else a chosen index, else the row."""
    target = (
        F.when(F.col("has_pk"), F.lit("d"))
        .when(F.col("replica_identity") == "i", F.lit("i"))
        .otherwise(F.lit("f"))
    )
    return tables.withColumn("target_identity", target).withColumn(
        "must_change", F.col("target_identity") != F.col("replica_identity")
    )


def publication_tables(
    tables: DataFrame, namespaces: DataFrame, published: DataFrame, primary_keys: DataFrame, publication: str
) -> DataFrame:
    """Ordinary tables of a publication with their primary-key flag and identity."""
    members = published.where(F.col("pubname") == publication).select("oid").distinct()
    names = namespaces.select(F.col("oid").alias("namespace_oid"), "nspname")
    keyed = primary_keys.select("oid").distinct().withColumn("has_pk", F.lit(True))
    return (
        tables.where("kind = 'r'")
        .join(names, "namespace_oid")
        .join(members, "oid")
        .join(keyed, "oid", "left")
        .select(
            "oid", "nspname", "relname", F.coalesce("has_pk", F.lit(False)).alias("has_pk"), "replica_identity"
        )
    )


def relation_columns(attributes: DataFrame, identity_index: DataFrame) -> DataFrame:
    """Live columns of each relation in order, flagged where the identity index has them.

    ``attributes``: relation_oid, attnum, name, type_oid, typmod, is_dropped.
    ``identity_index``: relation_oid, key_attnums (array).
    """
    joined = attributes.where("attnum > 0 and not is_dropped").join(identity_index, "relation_oid", "left")
    return joined.select(
        "relation_oid",
        "attnum",
        "name",
        "type_oid",
        "typmod",
        F.coalesce(F.array_contains("key_attnums", F.col("attnum")), F.lit(False)).alias("is_key"),
    ).orderBy("relation_oid", "attnum")


def collect_relations(relations: DataFrame, columns: DataFrame) -> DataFrame:
    """Relation headers with their columns as one array (a table has few columns)."""
    column = F.struct("attnum", "is_key", "name", "type_oid", "typmod")
    arrays = columns.groupBy("relation_oid").agg(
        F.transform(
            F.sort_array(F.collect_list(column)),
            lambda c: F.struct(c["is_key"], c["name"], c["type_oid"], c["typmod"]),
        ).alias("columns")
    )
    return relations.join(arrays, "relation_oid", "left")


def type_catalog(types: DataFrame, namespaces: DataFrame) -> DataFrame:
    """Types a client registers: id and name, qualified outside the standard namespaces.

    ``types``: oid, typname, typtype, typelem, namespace_oid.
    """
    element = types.select(F.col("oid").alias("typelem"), F.col("typtype").alias("element_kind"))
    names = namespaces.select(F.col("oid").alias("namespace_oid"), "nspname")
    joined = types.join(element, "typelem", "left").join(names, "namespace_oid", "left")
    known = joined.where(
        F.col("typtype").isin(*_TYPE_KINDS)
        & (F.col("element_kind").isNull() | F.col("element_kind").isin(*_ELEMENT_KINDS))
    )
    standard = F.col("nspname").isin("pg_catalog", "public")
    return known.select(
        "oid",
        F.when(standard, F.col("typname")).otherwise(F.concat("nspname", F.lit("."), "typname")).alias("type_name"),
    )


def enum_arrays(types: DataFrame) -> DataFrame:
    enums = types.where("typtype = 'e'").select(F.col("oid").alias("typelem"))
    return types.where("typtype = 'b'").join(enums, "typelem").select("oid", "typname")


def name_changes(relations: DataFrame, **scan) -> DataFrame:
    """Name history: an entry where the name differs from the one before, with the position
    at which the next entry takes over."""
    name = F.struct("namespace", "name")
    scan = {"levels": 2, **scan}
    previous = ordered_scan(relations, ["relation_oid"], ["lsn"], [Prev("__prev", name)], **scan)
    entries = previous.where(~F.col("__prev").eqNullSafe(name)).select(
        "relation_oid", "lsn", "namespace", "name", (-F.col("lsn")).alias("__back")
    )
    following = ordered_scan(entries, ["relation_oid"], ["__back"], [Prev("next_lsn", F.col("lsn"))], **scan)
    return following.select("relation_oid", "lsn", "next_lsn", "namespace", "name")


def resolve_name(name_history: DataFrame, requests: DataFrame, strict: bool = False, **scan) -> DataFrame:
    """Table id a name had at a position: newest entry of that name at or before ``at_lsn``.

    ``requests`` has ``namespace``, ``name`` and ``at_lsn`` (0 for no bound). An old name
    still resolves after a rename unless ``strict``. Two tables that took a name at one
    position resolve to the lower id. Requests without a match come back with null.
    """
    entries = name_history.groupBy("namespace", "name", "lsn").agg(
        F.min_by(F.struct("relation_oid", "next_lsn"), "relation_oid").alias("__e")
    )
    entries = entries.select("namespace", "name", "lsn", "__e.relation_oid", "__e.next_lsn")
    bound = F.when(F.col("at_lsn") == 0, F.lit(MAX_LSN)).otherwise(F.col("at_lsn")).cast("bigint")
    # One lookup per distinct question, however often it is asked.
    questions = requests.select("namespace", "name", "at_lsn").distinct().withColumn("__bound", bound)
    answers = asof_join(
        questions,
        entries.withColumnRenamed("lsn", "entry_lsn"),
        ["namespace", "name"],
        "__bound",
        "entry_lsn",
        ["relation_oid", "entry_lsn", "next_lsn"],
        **scan,
    )
    if strict:
        answers = answers.withColumn(
            "relation_oid",
            F.when(F.col("next_lsn").isNull() | (F.col("__bound") < F.col("next_lsn")), F.col("relation_oid")),
        )
    answers = answers.select("namespace", "name", "at_lsn", "relation_oid", "entry_lsn")
    return requests.join(answers, ["namespace", "name", "at_lsn"], "left")


def relation_version_asof(changes: DataFrame, relations: DataFrame, order: str = "lsn", **scan) -> DataFrame:
    """Each change with the schema version in force at it (``version_lsn``, null if none).

    Only the version's position is carried along the changes; join it to ``relations`` on
    ``(relation_oid, lsn)`` for the schema itself."""
    versions = relations.select("relation_oid", F.col("lsn").alias("version_lsn")).distinct()
    return asof_join(changes, versions, ["relation_oid"], order, "version_lsn", ["version_lsn"], **scan)


def relation_versions(relations: DataFrame, **scan) -> DataFrame:
    """Schema versions with the position at which the next one takes over."""
    back = relations.withColumn("__back", -F.col("lsn"))
    out = ordered_scan(
        back, ["relation_oid"], ["__back"], [Prev("next_lsn", F.col("lsn"))], **{"levels": 2, **scan}
    )
    return out.drop("__back")


def latest_relations(relations: DataFrame) -> DataFrame:
    rest = [c for c in relations.columns if c != "relation_oid"]
    newest = relations.groupBy("relation_oid").agg(F.max_by(F.struct(*rest), "lsn").alias("__r"))
    return newest.select("relation_oid", *[F.col(f"__r.{c}").alias(c) for c in rest])


def with_relation(changes: DataFrame, relations: DataFrame) -> DataFrame:
    """Changes with the columns of their relation (one row per relation). The relations are
    counted: so many are broadcast, beyond that both sides are salted."""
    side = relations.select(
        "relation_oid",
        *[c for c in ("namespace", "name", "replica_identity", "columns") if c in relations.columns],
    )
    return join_small(changes.drop(*[c for c in side.columns if c != "relation_oid"]), side, ["relation_oid"], "inner")


def relation_for(
    relations: DataFrame, namespace: str | None = None, name: str | None = None, oid: int | None = None
) -> DataFrame:
    """Newest version of a relation by id or by name."""
    if oid is not None:
        return latest_relations(relations.where(F.col("relation_oid") == oid))
    wanted = relations.where((F.col("namespace") == namespace) & (F.col("name") == name))
    return latest_relations(wanted)


def _columns_long(relations: DataFrame, *extra: str) -> DataFrame:
    return relations.select("relation_oid", *extra, F.posexplode("columns").alias("ordinal", "column"))


def schema_mismatches(a: DataFrame, b: DataFrame) -> DataFrame:
    """Where two sets of relations differ: name, identity, or a column at a position.

    No row for a relation means that both sides agree."""
    header = F.struct("namespace", "name", "replica_identity")
    left = a.select("relation_oid", header.alias("l"))
    right = b.select("relation_oid", header.alias("r"))
    heads = left.join(right, "relation_oid", "full")
    differs = F.filter(
        F.array(
            F.when(
                ~F.struct("l.namespace", "l.name").eqNullSafe(F.struct("r.namespace", "r.name")), F.lit("name")
            ),
            F.when(~F.col("l.replica_identity").eqNullSafe(F.col("r.replica_identity")), F.lit("identity")),
        ),
        lambda x: x.isNotNull(),
    )
    head_rows = heads.select("relation_oid", F.lit(-1).alias("ordinal"), F.explode(differs).alias("what"))
    columns = _columns_long(a).withColumnRenamed("column", "l").join(
        _columns_long(b).withColumnRenamed("column", "r"), ["relation_oid", "ordinal"], "full"
    )
    column_rows = columns.where(~F.col("l").eqNullSafe(F.col("r"))).select(
        "relation_oid", "ordinal", F.lit("column").alias("what")
    )
    return head_rows.unionByName(column_rows)


def schema_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes that lead from the old to the new schema, one row each: ``dropped``,
    ``added`` and ``altered`` columns, ``identity`` and ``renamed``."""
    o = _columns_long(old).select(
        "relation_oid", F.col("column.name").alias("name"), F.col("column").alias("o"), F.col("ordinal").alias("oi")
    )
    n = _columns_long(new).select(
        "relation_oid", F.col("column.name").alias("name"), F.col("column").alias("n"), F.col("ordinal").alias("ni")
    )
    both = o.join(n, ["relation_oid", "name"], "full")
    same_type = F.struct("o.type_oid", "o.typmod").eqNullSafe(F.struct("n.type_oid", "n.typmod"))
    kind = (
        F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "dropped").when(~same_type, "altered")
    )
    columns = both.withColumn("change", kind).where("change is not null")
    columns = columns.select(
        "relation_oid",
        "change",
        F.coalesce("ni", "oi").alias("ordinal"),
        F.col("name").alias("old_value"),
        F.when(F.col("n").isNotNull(), F.col("name")).alias("new_value"),
        F.col("n.type_oid").alias("type_oid"),
        F.col("n.typmod").alias("typmod"),
    )
    heads = old.select(
        "relation_oid", F.struct("namespace", "name").alias("oq"), F.col("replica_identity").alias("oi")
    ).join(
        new.select("relation_oid", F.struct("namespace", "name").alias("nq"), F.col("replica_identity").alias("ni")),
        "relation_oid",
    )
    none = F.lit(None)

    def head(condition: Column, change: str, before: Column, after: Column) -> Column:
        return F.when(
            condition,
            F.struct(
                F.lit(change).alias("change"),
                F.lit(-1).alias("ordinal"),
                before.alias("old_value"),
                after.alias("new_value"),
                none.cast("bigint").alias("type_oid"),
                none.cast("int").alias("typmod"),
            ),
        )

    changed = F.filter(
        F.array(
            head(F.col("oq.name") != F.col("nq.name"), "renamed", F.col("oq.name"), F.col("nq.name")),
            head(F.col("oi") != F.col("ni"), "identity", F.col("oi"), F.col("ni")),
        ),
        lambda x: x.isNotNull(),
    )
    return columns.unionByName(heads.select("relation_oid", F.inline(changed)))


def register_tables(relations: DataFrame, known: DataFrame, track_new: bool = True) -> DataFrame:
    """Tables first seen in the stream: the first Relation message of each unknown id."""
    rest = [c for c in relations.columns if c != "relation_oid"]
    unknown = relations.join(known.select("relation_oid"), "relation_oid", "left_anti")
    if not track_new:
        unknown = unknown.where(F.lit(False))
    first = unknown.groupBy("relation_oid").agg(F.min_by(F.struct(*rest), "lsn").alias("__r"))
    return first.select("relation_oid", *[F.col(f"__r.{c}").alias(c) for c in rest])
