import datetime
import sqlite3
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidestep.functions import formats
from tidestep.functions.missing import MISSING, compare_tagged, missing, sort_keys
from tidestep.functions.types import CHAR, NUM, TypeHandler, char_value, get_type, has_type, infer_type, num_value, register_type, type_names
from tidestep.operators.merge import match_merge, matched, update
from tidestep.operators.step import DataStep
from tidestep.sources.dialects import DIALECTS, declare
from tidestep.sources.readers import CursorRows, database_source, from_dicts, set_source, text_source


def test_missing_order():
    values = [3, missing("A"), missing("_"), 1, MISSING, missing("b")]
    assert [str(v) for v in sorted(values)] == ["._", ".", ".A", ".B", "1", "3"]
    assert MISSING == missing() and MISSING != missing("A") and 5 > MISSING and not 5 < MISSING and hash(missing("A")) == hash(missing("a"))
    with pytest.raises(ValueError):
        missing("ab")


def test_missing_order_in_frames(spark):
    df = spark.createDataFrame([(3, None), (None, "A"), (None, "_"), (1, None), (None, None), (None, "B")], "v int, tag string")
    got = [(r.v, r.tag) for r in df.orderBy(*sort_keys(F.col("v"), F.col("tag"))).collect()]
    assert got == [(None, "_"), (None, None), (None, "A"), (None, "B"), (1, None), (3, None)]
    below = df.where(compare_tagged("<", F.col("v"), F.col("tag"), F.lit(None).cast("int"), F.lit("A"))).collect()
    assert {r.tag for r in below} == {"_", None} and all(r.v is None for r in below)


def test_types():
    assert num_value("not-a-number") is MISSING and num_value(True) == 1 and num_value("2.5") == 2.5
    assert num_value(datetime.date(1961, 1, 1)) == 366
    assert char_value("HELLO", 3) == "HEL" and char_value(42.0) == "42" and char_value(None) == ""
    assert infer_type("x") == CHAR and infer_type(1) == NUM and {"num", "char", "decimal"} <= set(type_names())
    register_type(TypeHandler("upper", lambda c, k, n: F.upper(c), lambda v, n: str(v).upper(), "", 8))
    assert has_type("upper") and get_type("upper").value("a", None) == "A"


@pytest.mark.parametrize(("value", "spec", "text"), [(1234.5, "DOLLAR10.2", "$1,234.50"), (-5, "DOLLAR8.", "$-5"), (1234567.125, "COMMA12.2", "1,234,567.12"), (0, "DATE9.", "01JAN1960"), (0, "DATETIME19.", "01JAN1960:00:00:00"), (42.0, "", "42"), (3.14, "8.2", "3.14"), ("ab", "$4.", "ab  "), ("abcdef", "$4.", "abcd")])
def test_formats(spark, value, spec, text):
    assert formats.format_value(value, spec) == text
    df = spark.createDataFrame([(value,)], ["v"])
    assert df.select(formats.format_column(F.col("v"), spec, df.schema["v"].dataType.simpleString())).first()[0] == text


def test_missing_formats_and_unknown_names(spark):
    assert [formats.format_value(v, "DOLLAR8.2") for v in (MISSING, missing("_"), missing("A"))] == [".", "._", ".A"]
    df = spark.createDataFrame([(None, "A")], "v double, tag string")
    assert df.select(formats.format_column(F.col("v"), "DOLLAR8.2", "double", F.col("tag"))).first()[0] == ".A"
    with pytest.raises(KeyError):
        formats.format_value(1, "NOPE8.")
    assert formats.input_value("x", "NOPE8.") == "x"


@pytest.mark.parametrize(("text", "spec", "value"), [("01JAN1960", "DATE9.", 0), ("01JAN1961", "DATE9.", 366), ("$1,234.50", "DOLLAR10.2", 1234.5), ("1,234", "COMMA8.", 1234.0), ("02JAN1960:00:00:01", "DATETIME19.", 86401)])
def test_informats(spark, text, spec, value):
    assert formats.input_value(text, spec) == value
    assert spark.createDataFrame([(text,)], ["t"]).select(formats.input_column(F.col("t"), spec)).first()[0] == value


def test_own_formats(spark):
    formats.register_format("STARS", lambda v, w, d: "*" * int(v))
    formats.register_informat("STARS", lambda t, w: float(len(t)))
    df = spark.createDataFrame([(3.0,)], ["v"])
    assert df.select(formats.format_column(F.col("v"), "stars8.", "double")).first()[0] == "***"
    assert formats.input_value("****", "STARS8.") == 4.0


def merged(spark, **options):
    a = from_dicts(spark, [dict(id=1, a=10), dict(id=1, a=20), dict(id=2, a=30)])
    b = from_dicts(spark, [dict(id=1, b=100), dict(id=2, b=200), dict(id=2, b=300)])
    return match_merge({"A": set_source(a, order_by=["_obs"]), "B": set_source(b, order_by=["_obs"])}, ["id"], {"A": "inA", "B": "inB"}, **options)


def test_merge(spark):
    got = merged(spark).df.orderBy("id", "_pos").select("id", "a", "b", "inA", "inB").collect()
    assert [tuple(r) for r in got] == [(1, 10, 100, 1, 1), (1, 20, 100, 1, 0), (2, 30, 200, 1, 1), (2, 30, 300, 0, 1)]
    group = merged(spark, in_scope="group").df.orderBy("id", "_pos").select("inA", "inB").collect()
    assert [tuple(r) for r in group] == [(1, 1)] * 4


def test_merge_does_not_leak_and_last_write_wins(spark):
    x, y = from_dicts(spark, [dict(id=1, v=99)]), from_dicts(spark, [dict(id=1, w=7), dict(id=2, w=8)])
    got = match_merge({"X": set_source(x, order_by=["_obs"]), "Y": set_source(y, order_by=["_obs"])}, ["id"]).df.orderBy("id").select("v", "w").collect()
    assert [tuple(r) for r in got] == [(99, 7), (None, 8)]
    a, b = (spark.createDataFrame([(1, f"from_{s}")], "id int, shared string") for s in "ab")
    assert match_merge({"A": set_source(a, order_by=["shared"]), "B": set_source(b, order_by=["shared"])}, ["id"]).df.first()["shared"] == "from_b"


def test_merge_of_three_with_null_keys_and_values(spark):
    sources = {
        "A": spark.createDataFrame([(None, 1, "a0"), (1, 1, "a1"), (1, 2, None)], "id int, o int, s string"),
        "B": spark.createDataFrame([(None, 1, 5), (1, 1, 6)], "id int, o int, b int"),
        "C": spark.createDataFrame([(1, 1, "c1"), (2, 1, "c2")], "id int, o int, s string"),
    }
    out = match_merge({k: set_source(v, order_by=["o"]) for k, v in sources.items()}, ["id"], {k: f"in{k}" for k in sources}).df.orderBy(F.col("id").asc_nulls_first(), "_pos")
    got = [tuple(r) for r in out.select("id", "s", "b", "inA", "inB", "inC").collect()]
    assert got == [(None, "a0", 5, 1, 1, 0), (1, "c1", 6, 1, 1, 1), (1, None, 6, 1, 0, 0), (2, "c2", None, 0, 0, 1)]


def test_unique_sources_join_once(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id int, a string")
    b = spark.createDataFrame([(1, 1), (1, 2), (3, 3)], "id int, b int")
    with pytest.raises(ValueError, match="order_by"):
        match_merge({"A": set_source(a), "B": set_source(b, order_by=["b"])}, ["id"])
    slow = match_merge({"A": set_source(a, order_by=["a"]), "B": set_source(b, order_by=["b"])}, ["id"], {"A": "inA", "B": "inB"})
    fast = match_merge({"A": set_source(a), "B": set_source(b, order_by=["b"])}, ["id"], {"A": "inA", "B": "inB"}, unique=["A"])
    pick = lambda s: sorted(map(str, s.df.select("id", "a", "b", "inA", "inB", "_pos").collect()))
    assert pick(slow) == pick(fast)


def test_matched_and_update(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id int, a string")
    b = spark.createDataFrame([(1, 5)], "id int, b int")
    both = {"A": set_source(a), "B": set_source(b)}
    assert [r.id for r in matched(both, ["id"], "semi").collect()] == [1]
    assert [r.id for r in matched(both, ["id"], "anti").collect()] == [2]
    changes = spark.createDataFrame([(1, None, 1), (1, "z", 2), (1, None, 3), (3, "new", 1)], "id int, a string, o int")
    got = {r.id: r.a for r in update(set_source(a), set_source(changes, order_by=["o"]), ["id"]).collect()}
    assert got == {1: "z", 2: "y", 3: "new"}


def test_database(spark):
    c = sqlite3.connect(":memory:")
    c.execute("create table kv (k text, v real)")
    c.executemany("insert into kv values (?, ?)", [("a", 1.0), ("b", 2.0), ("c", 3.0)])
    cursor = c.execute("select k, v from kv order by k")
    assert list(CursorRows(cursor, 2)) == [{"k": "a", "v": 1.0}, {"k": "b", "v": 2.0}, {"k": "c", "v": 3.0}]
    source = database_source(spark, c.execute("select k, v from kv"), arraysize=2)
    assert sorted((r.k, r.v) for r in source.df.collect()) == [("a", 1.0), ("b", 2.0), ("c", 3.0)]


class Cursor:
    def __init__(self, description, rows):
        self.description, self.rows = description, rows

    def fetchmany(self, n):
        out, self.rows = self.rows[:n], self.rows[n:]
        return out


@pytest.mark.parametrize(("dialect", "code"), [("postgresql", 1700), ("mysql", 246), ("oracle", "DB_TYPE_NUMBER"), ("sqlserver", Decimal)])
def test_precision_decides(dialect, code):
    assert DIALECTS[dialect].types.resolve(("n", code, None, None, 38, 2, None))[0] == "decimal"
    assert DIALECTS[dialect].types.resolve(("n", code, None, None, 8, 0, None))[0] == "num"


def test_exact_decimals_and_dates_from_a_cursor(spark):
    value = Decimal("12345678901234567890.12")
    cursor = Cursor([("n", 1700, None, None, 38, 2, None), ("d", 1082, None, None, None, None, None)], [(value, datetime.date(1961, 1, 1))])
    source = database_source(spark, cursor, "postgresql")
    assert source.df.first()["n"] == value and source.df.first()["d"] == 366
    assert DataStep(source, shown).to_df().first()["text"] == "01JAN1961"


def shown(pdv):
    pdv["text"] = pdv.put("d")


def test_declarations():
    assert (declare("a", "VARCHAR2(3)", "oracle").stype, declare("a", "VARCHAR2(3)", "oracle").length) == ("char", 3)
    assert declare("b", "NUMBER(38,2)", "oracle").data_type.simpleString() == "decimal(38,2)"
    assert declare("c", "DATE", "oracle").fmt == "DATE9."
    assert declare("d", "MONEY", "sqlserver").stype == "num" and declare("e", "FLOAT(126)", "oracle").stype == "decimal"
    for bad in (("JSONB", "postgresql"), ("INT", "db2"), ("!!!", "mysql")):
        with pytest.raises(ValueError):
            declare("x", *bad)


def test_fixed_width_text(spark, tmp_path):
    (tmp_path / "t.txt").write_text("01JAN1961 $1,234.50\n01JAN1960          \n")
    df = text_source(spark, str(tmp_path / "t.txt"), {"d": (1, 9, "DATE9."), "m": (11, 9, "DOLLAR9.2")}).df
    assert sorted((r.d, r.m) for r in df.collect()) == [(0, None), (366, 1234.5)]


def step(pdv):
    pdv["net"] = pdv["qty"] * 2
    pdv["before"] = pdv.lag(pdv["net"])
    if pdv["net"] > 100:
        pdv["band"] = 1
    pdv["later"] = pdv["before"] + 1
    pdv.output()


def plain(pdv):
    pdv["y"] = pdv["x"] + 1


def test_advisor(spark):
    df = spark.createDataFrame([(1, 2)], "qty int, o int")
    r = DataStep(df, step, order_by=["o"]).explain_step()
    assert r.path == "hybrid" and [x.category for x in r.lines] == ["batch", "irreducible", "tool-limited", "dependency", "cardinality"]
    assert r.lines[1].blockers == ("lag(n=1)",) and r.lines[3].blockers == ("before",) and "hybrid" in r.text
    assert DataStep(spark.range(1).toDF("x"), plain).explain_step().path == "vector"
    assert r.to_df(spark).count() == 5
