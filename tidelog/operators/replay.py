"""Replay: from a snapshot and later changes to the rows of a table.

Row changes are wide: key columns, ``op`` (I, U or D), order columns, and for every data
column ``c`` its text or value ``c`` and its kind ``c__kind`` (``t`` sent, ``n`` null,
``u`` unchanged). An update that changes the key also has ``old_<key>`` set.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.cells import zip_columns
from tidelog.operators.lookup import join_small
from tidelog.operators.scan import Last, Prev, ordered_scan
from tidelog.schema import NULL_CELL, TEXT_CELL, UNCHANGED_CELL
from tidelog.session import cut_lineage

ORDER = ("final_lsn", "pos", "seq")
BASE_POS = -1


def _order(order: Sequence[str]) -> Column:
    return F.col(order[0]) if len(order) == 1 else F.struct(*order)


def _scan_order(order: Sequence[str]) -> list[str | None]:
    """Blocks are cut inside transactions; what follows the position only breaks ties."""
    return [*order[:2], None, *order[2:]] if len(order) > 2 else list(order)


def _sent(column: str) -> Column:
    """Null where the cell was not sent. A null cell is a value and must stay one."""
    return F.col(f"{column}__kind") != UNCHANGED_CELL


def _latest(column: str, order: Column) -> Column:
    return F.max_by(F.struct(F.col(column).alias("v")), F.when(_sent(column), order))


def replay_keyed(
    changes: DataFrame, keys: Sequence[str], columns: Sequence[str], order: Sequence[str] = ORDER
) -> DataFrame:
    """Final row per key, for logs in which no row changes its key.

    One aggregate by key with map-side combine: per column the newest sent cell, and the key
    is live iff its last insert is later than its last delete. An insert carries every
    column, so the newest sent cell never stems from an earlier life of the key. Updates of
    a row that is not live change nothing, as they should.
    """
    at = _order(order)
    image = changes.groupBy(*keys).agg(
        F.max(F.when(F.col("op") == "I", at)).alias("__in"),
        F.max(F.when(F.col("op") == "D", at)).alias("__out"),
        *[_latest(c, at).alias(c) for c in columns],
    )
    live = image.where(F.col("__in").isNotNull() & (F.col("__out").isNull() | (F.col("__in") > F.col("__out"))))
    return live.select(*keys, *[F.col(f"{c}.v").alias(c) for c in columns])


def _moves(changes: DataFrame, keys: Sequence[str], by: Sequence[str]) -> tuple[list[str], Column]:
    moving = [k for k in keys if k not in by]
    return moving, F.col(f"old_{moving[0]}").isNotNull()


def replay_moves(
    changes: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    order: Sequence[str] = ORDER,
    by: Sequence[str] = ("relation_oid",),
    **scan,
) -> DataFrame:
    """Final row per key, for logs with key-changing updates.

    Only keys that some move leaves or enters need the history of their lives; all other
    keys take the plain aggregate. A life of a key starts with an insert or a move in and
    ends with a delete or a move out. A move links the life under the new key to the one
    under the old key, and doubling those links finds the first life of every row in
    log2(longest chain) rounds. Cells are then aggregated per row, over all its keys.
    """
    by = [b for b in by if b in changes.columns]
    keys = list(keys)
    moving, is_move = _moves(changes, keys, by)
    fixed = [k for k in keys if k not in moving]
    old = [F.col(f"old_{k}").alias(k) for k in moving]

    moves = changes.where(is_move)
    affected = (
        moves.select(*fixed, *moving).unionByName(moves.select(*fixed, *old)).distinct()
    )
    # Aggregated first: the anti-join then meets one row per key, not all changes of a hot one.
    untouched = replay_keyed(changes, keys, columns, order).join(affected, keys, "left_anti")

    cells = [x for c in columns for x in (c, f"{c}__kind")]
    keep = [*keys, *order, *cells]
    arrivals = changes.withColumn("__event", F.when(is_move, F.lit("in")).otherwise(F.col("op")))
    departures = moves.select(*fixed, *old, *order, *cells).withColumn("__event", F.lit("out"))
    events = (
        arrivals.select(*keep, "__event").unionByName(departures.select(*keep, "__event")).join(
            affected, keys, "left_semi"
        )
    )

    # Boundary in force at each event, and the one before it.
    boundary = F.when(
        F.col("__event").isin("I", "in", "D", "out"), F.struct(F.struct(*order).alias("at"), F.col("__event").alias("e"))
    )
    scanned = ordered_scan(
        events, keys, _scan_order(order), [Last("__b", boundary), Prev("__p", boundary)], **{"levels": 2, **scan}
    )
    lives = cut_lineage(scanned.withColumn("__key", F.struct(*moving)).withColumn("__at", F.struct(*order)))

    # One link per live move: life under the new key -> life under the old key.
    def life(key: Column, at: Column) -> Column:
        return F.struct(*[F.col(b) for b in fixed], key.alias("key"), at.alias("at"))

    into = lives.where("__event = 'in'").select(*fixed, F.col("__at"), life(F.col("__key"), F.col("__at")).alias("child"))
    outof = lives.where("__event = 'out' and __p.e in ('I', 'in')").select(
        *fixed, F.col("__at"), life(F.col("__key"), F.col("__p.at")).alias("parent")
    )
    links = into.join(outof, [*fixed, "__at"], "left").select("child", "parent")
    roots = resolve_roots(links)

    # Events inside a life that is alive at that point.
    member = lives.where("__b.e in ('I', 'in')").select(
        life(F.col("__key"), F.col("__b.at")).alias("life"), "__key", "__at", "__event", *fixed, *cells
    )
    rooted = member.join(roots, member["life"] == roots["child"], "left").where("child is null or root is not null")
    row = F.coalesce(F.col("root"), F.col("life"))
    at = F.col("__at")
    image = rooted.groupBy(*fixed, row.alias("__row")).agg(
        F.max_by(F.col("life"), F.when(F.col("__event").isin("I", "in"), at)).alias("__life"),
        *[_latest(c, at).alias(c) for c in columns],
    )
    # The row is there iff its newest life was not ended: the last boundary of that key.
    ended = lives.where("__event in ('D', 'out') and __p.e in ('I', 'in')").select(
        life(F.col("__key"), F.col("__p.at")).alias("__life")
    )
    # A second insert on a live key replaces the first.
    replaced = lives.where("__event in ('I', 'in') and __p.e in ('I', 'in')").select(
        life(F.col("__key"), F.col("__p.at")).alias("__life")
    )
    gone = ended.unionByName(replaced).distinct()
    live = image.join(gone, "__life", "left_anti")
    moved = live.select(
        *fixed, *[F.col(f"__life.key.{k}").alias(k) for k in moving], *[F.col(f"{c}.v").alias(c) for c in columns]
    )
    return untouched.unionByName(moved.select(untouched.columns))


def resolve_roots(links: DataFrame) -> DataFrame:
    """``(child, parent)`` links to ``(child, root)`` by pointer doubling.

    A null parent is a dead end (the move found no row): everything behind it gets a null
    root. Each round halves the distance to the root and is written to the shared folder;
    links that are settled are not written again.
    """
    written = cut_lineage(links.select("child", F.col("parent").alias("root"), F.lit(True).alias("open")))
    unsettled = F.col("open") & F.col("root").isNotNull()
    settled, pending = written.where(~unsettled), written.where(unsettled)
    while not pending.isEmpty():
        hop = settled.unionByName(pending).select(F.col("child").alias("__child"), F.col("root").alias("__root"))
        # A root that is itself a child is an inner node and is followed; others are final.
        joined = pending.join(hop, F.col("root") == F.col("__child"), "left")
        written = cut_lineage(joined.select(
            "child",
            F.when(F.col("__child").isNotNull(), F.col("__root")).otherwise(F.col("root")).alias("root"),
            F.col("__child").isNotNull().alias("open"),
        ))
        settled, pending = settled.unionByName(written.where(~unsettled)), written.where(unsettled)
    return settled.select("child", "root")


def replay(
    changes: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    order: Sequence[str] = ORDER,
    by: Sequence[str] = ("relation_oid",),
    moves: bool | None = None,
    **scan,
) -> DataFrame:
    """Keyed replay; ``moves=None`` looks whether any update changes a key."""
    moving = [k for k in keys if k not in by]
    if f"old_{moving[0]}" not in changes.columns:
        return replay_keyed(changes, keys, columns, order)
    if moves is None:
        moves = not changes.where(F.col(f"old_{moving[0]}").isNotNull()).isEmpty()
    if not moves:
        return replay_keyed(changes, keys, columns, order)
    return replay_moves(changes, keys, columns, order, by, **scan)


def replay_anomalies(
    changes: DataFrame, keys: Sequence[str], order: Sequence[str] = ORDER, **scan
) -> DataFrame:
    """Changes a database would have refused or that would have hit no row, per key and kind."""
    event = F.when(F.col("op") == "U", None).otherwise(F.struct(F.col("op").alias("e")))
    seen = ordered_scan(changes, list(keys), _scan_order(order), [Prev("__p", event)], **{"levels": 2, **scan})
    live = F.coalesce(F.col("__p.e") == "I", F.lit(False))
    kind = (
        F.when((F.col("op") == "I") & live, F.lit("insert_on_live_key"))
        .when((F.col("op") == "U") & ~live, F.lit("update_of_missing_row"))
        .when((F.col("op") == "D") & ~live, F.lit("delete_of_missing_row"))
    )
    return (
        seen.withColumn("anomaly", kind).where("anomaly is not null").groupBy(*keys, "anomaly").agg(
            F.count("*").alias("changes")
        )
    )


def after_truncate(
    changes: DataFrame, truncates: DataFrame, order: Sequence[str] = ORDER, by: str = "relation_oid"
) -> DataFrame:
    """Drop what a later truncate of the relation removed. ``truncates`` has ``by`` and the
    order columns; the newest one per relation is the barrier."""
    at = F.struct(*order)
    barrier = truncates.groupBy(by).agg(F.max(at).alias("__barrier"))
    marked = join_small(changes, barrier, [by])
    return marked.where(F.col("__barrier").isNull() | (at > F.col("__barrier"))).drop("__barrier")


def base_as_inserts(base: DataFrame, columns: Sequence[str], order: Sequence[str] = ORDER, start_lsn: str = "start_lsn") -> DataFrame:
    """Snapshot rows as inserts at the snapshot's position, before any change of it."""
    out = base.withColumn("op", F.lit("I"))
    for c in columns:
        out = out.withColumn(f"{c}__kind", F.when(F.col(c).isNull(), F.lit(NULL_CELL)).otherwise(F.lit(TEXT_CELL)))
    for i, name in enumerate(order):
        at = F.col(start_lsn) if i == 0 and name != "pos" else F.lit(BASE_POS)
        out = out.withColumn(name, at.cast("int" if name == "seq" else "bigint"))
    return out


def base_plus_tail(
    base: DataFrame, tail: DataFrame, keys: Sequence[str], columns: Sequence[str], order: Sequence[str] = ORDER
) -> DataFrame:
    """Snapshot rows followed by the changes after it, as one change set."""
    rows = base_as_inserts(base, columns, order)
    wanted = [*keys, "op", *order, *[x for c in columns for x in (c, f"{c}__kind")]]
    olds = [c for c in tail.columns if c.startswith("old_")]
    return rows.select(*wanted).unionByName(tail.select(*wanted, *olds), allowMissingColumns=True)


def row_changes(
    changes: DataFrame, columns: Sequence, keep: Sequence[str] = ("relation_oid", *ORDER)
) -> tuple[DataFrame, list[str], list[str]]:
    """Insert, update and delete messages of one table layout as wide row changes.

    Returns the frame with its key and data column names. Under a key identity the old key
    comes from the identity tuple; an update whose old key equals the new one is no move.
    """
    keys = [c["name"] for c in columns if c["is_key"]]
    data = [c["name"] for c in columns if not c["is_key"]]
    ordinal = {c["name"]: i for i, c in enumerate(columns)}

    def at(side: str, name: str) -> Column:
        return F.get(F.col(side), F.lit(ordinal[name]))

    is_delete = F.col("msg_type") == "delete"
    out = [F.col(k) for k in keep]
    out.append(
        F.when(F.col("msg_type") == "insert", F.lit("I")).when(is_delete, F.lit("D")).otherwise(F.lit("U")).alias("op")
    )
    # A full-identity update whose key cell is unchanged keeps the key of the old row.
    new_key = {
        k: F.when(at("new_row", k)["kind"] == UNCHANGED_CELL, at("ident", k)["value"]).otherwise(
            at("new_row", k)["value"]
        )
        for k in keys
    }
    moved = F.lit(False)
    for k in keys:
        moved = moved | ~at("ident", k)["value"].eqNullSafe(new_key[k])
    is_move = (F.col("msg_type") == "update") & F.col("ident").isNotNull() & moved
    for k in keys:
        out.append(F.when(is_delete, at("ident", k)["value"]).otherwise(new_key[k]).alias(k))
        out.append(F.when(is_move, at("ident", k)["value"]).alias(f"old_{k}"))
    for c in data:
        out.append(at("new_row", c)["value"].alias(c))
        out.append(F.when(~is_delete, at("new_row", c)["kind"]).alias(f"{c}__kind"))
    rows = changes.where(F.col("msg_type").isin("insert", "update", "delete"))
    return rows.select(*out), keys, data


# --- full identity ---------------------------------------------------------------------


def signed_rows(changes: DataFrame, columns: Sequence) -> DataFrame:
    """Full-identity messages as signed rows: +1 the new image, -1 the old one.

    Unchanged cells of the new image are filled from the old one."""
    names = [c["name"] for c in columns]

    def value(side: str, i: int) -> Column:
        return F.get(F.col(side), F.lit(i))["value"]

    def filled(i: int) -> Column:
        new = F.get(F.col("new_row"), F.lit(i))
        return F.when(new["kind"] == UNCHANGED_CELL, value("ident", i)).otherwise(new["value"])

    plus = F.struct(F.lit(1).cast("bigint").alias("w"), *[filled(i).alias(n) for i, n in enumerate(names)])
    minus = F.struct(F.lit(-1).cast("bigint").alias("w"), *[value("ident", i).alias(n) for i, n in enumerate(names)])
    sides = F.filter(
        F.array(
            F.when(F.col("msg_type").isin("insert", "update"), plus),
            F.when(F.col("msg_type").isin("delete", "update"), minus),
        ),
        lambda s: s.isNotNull(),
    )
    rows = changes.where(F.col("msg_type").isin("insert", "update", "delete"))
    return rows.select(*[c for c in ("relation_oid",) if c in changes.columns], F.inline(sides))


def replay_counts(signed: DataFrame, columns: Sequence[str], weight: str = "w") -> DataFrame:
    """Net number of copies per row; negative counts mean an inconsistent log."""
    return signed.groupBy(*columns).agg(F.sum(weight).cast("bigint").alias("n")).where("n <> 0")


def expand_copies(counts: DataFrame, n: str = "n", chunk: int = 1_000_000) -> DataFrame:
    """Each row ``n`` times. Rows with many copies are cut into chunks that are spread over
    the cluster before they are written out, so no task emits a hot row alone."""
    chunks = counts.where(F.col(n) > 0).withColumn(
        "__from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1, F.lit(chunk).cast("bigint")))
    )
    chunks = chunks.withColumn("__size", F.least(F.lit(chunk).cast("bigint"), F.col(n) - F.col("__from")))
    spread = chunks.repartition(F.col("__from"), *[F.col(c) for c in counts.columns if c != n])
    copies = spread.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__size"))))
    return copies.drop("__from", "__size", "__i", n)


def replay_full(signed: DataFrame, columns: Sequence[str], weight: str = "w") -> DataFrame:
    """Rows of a table without a key: a multiset, so only net counts matter."""
    return expand_copies(replay_counts(signed, columns, weight))


def tuple_long(changes: DataFrame, columns: str = "columns", cells: str = "new_row", keep: Sequence[str] = ()) -> DataFrame:
    """One row per cell, paired with its column."""
    zipped = F.posexplode(zip_columns(F.col(columns), F.col(cells)))
    exploded = changes.select(*keep, zipped.alias("ordinal", "__cell"))
    return exploded.select(
        *keep,
        "ordinal",
        *[F.col(f"__cell.{c}").alias(c) for c in ("name", "is_key", "type_oid", "kind", "value")],
    )
