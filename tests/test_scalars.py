import pytest
from pyspark.sql import functions as F

from tidelog.functions import cells, lsn, text, types
from tidelog.operators import catalog, render


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_lsn(spark):
    assert one(spark, lsn.lsn_parse(F.lit("16/B374D848"))) == 97500059720
    assert one(spark, lsn.lsn_format(F.lit(97500059720))) == "16/B374D848"
    assert one(spark, lsn.lsn_hex(F.lit(97500059720))) == "00000016b374d848"
    assert one(spark, lsn.lsn_valid(F.lit(0))) is False
    with pytest.raises(Exception, match="63 bits"):
        one(spark, lsn.from_hex(F.lit("ffffffffffffffff")))


def test_segment_names_and_shard(spark):
    name = F.lit("00000016b374d848.1")
    assert one(spark, lsn.segment_lsn(name)) == 97500059720
    assert one(spark, lsn.segment_postfix_of(name)) == 1
    assert one(spark, lsn.segment_postfix_of(F.lit("00000016b374d848"))) == 0
    assert one(spark, lsn.segment_postfix_of(F.lit("00000016b374d848.10"))) == 10
    assert one(spark, lsn.shard_path(F.lit(16385))) == "01/40/00/16385"


def test_quoting(spark):
    assert one(spark, text.quote_literal(F.lit("d'\\x"))) == "E'd''\\\\x'"
    assert one(spark, text.quote_literal(F.lit("plain"))) == "'plain'"
    assert one(spark, text.quote_literal(F.lit("a\nb"))) == "E'a\\nb'"
    assert one(spark, text.quote_ident(F.lit('we"ird'))) == '"we""ird"'


@pytest.mark.parametrize(
    "field,value",
    [
        ("a\\tb\\\\nc\\nd", "a\tb\\nc\nd"),
        ("\\N", None),
        ("\\\\N", "\\N"),
        ("", ""),
        ("\\\\\\\\", "\\\\"),
        ("\\\\\\t", "\\\t"),
        ("\\.x", ".x"),
    ],
)
def test_copy_fields(spark, field, value):
    assert one(spark, text.copy_unescape(F.lit(field))) == value


def test_copy_escape_is_the_inverse(spark):
    for value in ["a\tb", "x\\", "\\N", "\r\n\b\f\v", "ünï", "", "\\\\t"]:
        assert one(spark, text.copy_unescape(text.copy_escape(F.lit(value)))) == value
    assert one(spark, text.copy_escape(F.lit(None).cast("string"))) == "\\N"


def test_types(spark):
    def t(v, oid, typmod=-1):
        return one(spark, types.typed_value(F.lit(v), oid, typmod))

    assert t("t", types.BOOL) is True and t("f", types.BOOL) is False
    assert t("12", types.INT4) == 12 and t("x", types.INT4) is None
    assert str(t("1.5", types.NUMERIC, ((10 << 16) | 2) + 4)) == "1.50"
    assert t("NaN", types.NUMERIC) == "NaN"
    assert t("0044-03-15 BC", types.DATE) is None
    assert str(t("2024-02-29", types.DATE)) == "2024-02-29"
    assert t("infinity", types.TIMESTAMP) is None
    assert t("2024-01-01 05:30:00+05:30", types.TIMESTAMPTZ).isoformat() == "2024-01-01T00:00:00"
    assert bytes(t("\\x00ff", types.BYTEA)) == b"\x00\xff"
    assert t("{1,NULL,3}", types.INT4_ARRAY) == [1, None, 3] and t("{}", types.INT4_ARRAY) == []
    assert t("{{1},{2}}", types.INT4_ARRAY) is None
    assert types.spark_type(types.NUMERIC, ((50 << 16) | 2) + 4) == "string"


def test_cast_errors_are_counted(spark):
    df = spark.createDataFrame([("1", "x"), ("y", "z")], "a string, b string")
    columns = [{"name": "a", "type_oid": 23, "typmod": -1}, {"name": "b", "type_oid": 23, "typmod": -1}]
    assert sorted(r.cast_errors for r in types.typed(df, columns).collect()) == [1, 2]


def test_identity_names(spark):
    assert one(spark, catalog.identity_name(F.lit("i"))) == "index"
    assert one(spark, catalog.identity_name(F.lit("?"))) == "default"
    assert one(spark, catalog.identity_code(F.lit("full"))) == "f"
    with pytest.raises(Exception, match="unknown replica identity"):
        one(spark, catalog.identity_code(F.lit("no such")))


@pytest.mark.parametrize(
    "has_pk,now,want", [(True, "i", "d"), (False, "i", "i"), (False, "d", "f"), (False, "n", "f"), (False, "f", "f"), (True, "d", "d")]
)
def test_target_identity(spark, has_pk, now, want):
    df = spark.createDataFrame([(has_pk, now)], "has_pk boolean, replica_identity string")
    row = catalog.target_identity(df).first()
    assert row.target_identity == want and row.must_change == (want != now)


def test_display_name(spark):
    assert one(spark, render.display_name(F.lit("public"), F.lit("t"))) == "t"
    assert one(spark, render.display_name(F.lit("app"), F.lit("t"))) == "app.t"


def test_update_without_a_locator_is_not_rendered(spark):
    from tidelog.schema import COLUMNS, TUPLE
    from pyspark.sql import types as T

    schema = T.StructType(
        [
            T.StructField("msg_type", T.StringType()),
            T.StructField("namespace", T.StringType()),
            T.StructField("name", T.StringType()),
            T.StructField("ident", TUPLE),
            T.StructField("ident_is_key", T.BooleanType()),
            T.StructField("new_row", TUPLE),
            T.StructField("columns", COLUMNS),
        ]
    )
    columns = [(False, "a", 25, -1)]
    rows = [("update", "public", "t", None, None, [("t", "1")], columns), ("delete", "public", "t", None, None, None, columns)]
    assert [r.sql for r in render.render_dml(spark.createDataFrame(rows, schema)).collect()] == [None, None]


def test_unknown_cell_kind(spark):
    cell = cells.cell(F.lit("?"), F.lit(None))
    assert one(spark, cells.kind_name(cell)) == "unknown"
