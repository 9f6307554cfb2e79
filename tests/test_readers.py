import sqlite3
from decimal import Decimal

from tidestep.sources.readers import database_source, from_dicts


def test_schema_does_not_depend_on_the_chunk(spark):
    data = [{"i": 1, "none": None}, {"i": 2, "none": None}, {"i": 1.9, "none": "text"}, {"i": 4, "late": 7}, {"d": 3}, {"d": Decimal("1.5")}, {"b": True}, {"b": "x"}]
    whole, parts = from_dicts(spark, data), from_dicts(spark, data, chunk=2)
    assert parts.schema == whole.schema and sorted(parts.collect(), key=lambda r: r._obs) == whole.collect()
    got = sorted(parts.collect(), key=lambda r: r._obs)
    assert [r.i for r in got[:4]] == [1.0, 2.0, 1.9, 4.0] and got[2].none == "text" and got[3].late == 7
    assert [r.d for r in got[4:6]] == [3, Decimal("1.5")] and [r.b for r in got[6:]] == ["True", "x"]


def test_cursor_column_widens_after_the_first_chunk(spark):
    con = sqlite3.connect(":memory:")
    con.execute("create table t (x)")
    con.executemany("insert into t values (?)", [(k,) for k in range(25)] + [(1.9,)])
    got = database_source(spark, con.execute("select x from t order by rowid"), arraysize=1).df.orderBy("_obs").collect()
    assert [r.x for r in got] == [*map(float, range(25)), 1.9]
