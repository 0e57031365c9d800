"""Every query of the library that has an SQL oracle, against DuckDB over the small tables."""

import math
import os

import pytest

from skyloom.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(x):
    return "nan" if isinstance(x, float) and math.isnan(x) else repr(x)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    result = con.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    """Every column of every row is computed; what the rows hold is tested with the operators."""
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    assert all(set(r.asDict()) == set(df.columns) for r in rows)


def test_scenario_frames_of_thousands_of_stations_equal_sql(spark):
    """Positions at which the seeds of noise, summed as fractions, showed in the frames."""
    duckdb = pytest.importorskip("duckdb")
    from skyloom.operators import scenario as SC
    from skyloom.plans.scenarios import steps_sql

    mixes = [(3839, 0.995705, 0.411869, 0.196455, 0.391675), (4692, 0.974952, 0.411602, 0.198962, 0.389436), (5353, 0.978762, 0.40042, 0.216435, 0.383145), (5514, 0.956709, 0.411068, 0.183378, 0.405554)]
    rows = [(di, f"s{di}", *rest) for di, *rest in mixes]
    d = spark.createDataFrame(rows, "di int, district string, emission double, stubble double, traffic double, industry double")
    got = sorted(map(tuple, SC.frames(d, 40, 25, 10).select("district", "hour", "pm25", "pbl", "solar", "wind").collect()))
    values = ", ".join(f"({di}::BIGINT, '{name}', {', '.join(f'{x}::DOUBLE' for x in rest)})" for di, name, *rest in rows)
    want = duckdb.sql(f"""WITH RECURSIVE d AS (SELECT * FROM (VALUES {values}) x(di, district, emission, stubble, traffic, industry)), {steps_sql("r", "d", 0.6, 0.75, 0.9)}
        SELECT district, h::INTEGER, floor(pm * 10 + 0.5) / 10, floor(pbl + 0.5)::BIGINT, floor(solar + 0.5)::BIGINT, floor(wind * 10 + 0.5) / 10 FROM r WHERE h >= 0""")
    assert got == sorted(want.fetchall()) and len(got) == 4 * 73


def test_tools_answer_by_name(spark):
    from skyloom.plans.tools import TOOLS, ask

    assert len(TOOLS) == 8
    days = ask(spark, SF, "city_history", days=7).first()
    assert days["days"] == 7 and days["mean"] > 0
    assert [r["hours"] for r in ask(spark, SF, "index_rules", pollutant="o3").collect()] == [8]
    assert ask(spark, SF, "station_detail", station="supplier#000000001, delhi - cpcb").count() == ask(spark, SF, "station_detail", station="0001,").count() == 1
    assert ask(spark, SF, "station_detail", station="nowhere").count() == 0
    everything, later = (ask(spark, SF, "fire_corridor", since=s).agg({"pixels": "sum"}).first()[0] for s in (None, "1998-01-01"))
    assert 0 < later < everything
    assert [r["lead"] for r in ask(spark, SF, "forecast", hours=24).orderBy("lead").collect()] == [6, 12, 18, 24]
    assert ask(spark, SF, "city_history").first()["days"] == 30
    assert ask(spark, SF, "station_detail", station="' OR 1 = 1 --").count() == 0
    assert ask(spark, SF, "fire_corridor").count() > 0 and ask(spark, SF, "index_rules").count() > 5


@pytest.mark.parametrize(
    ("name", "given"),
    [
        ("weather", {}),
        ("city_now", {"hour": 3}),
        ("station_detail", {}),
        ("station_detail", {"station": 5}),
        ("station_detail", {"station": "  "}),
        ("forecast", {"hours": 0}),
        ("forecast", {"hours": 73}),
        ("forecast", {"hours": "24"}),
        ("forecast", {"hours": 24.0}),
        ("forecast", {"hours": True}),
        ("fire_corridor", {"since": "1998-02-30"}),
        ("fire_corridor", {"since": "19980201"}),
        ("fire_corridor", {"since": "' OR true"}),
        ("city_history", {"days": 31}),
        ("city_history", {"days": -1}),
        ("index_rules", {"pollutant": "pm1"}),
    ],
)
def test_tools_refuse_what_they_cannot_take(spark, name, given):
    from skyloom.plans.tools import Refused, ask

    with pytest.raises(Refused):
        ask(spark, SF, name, **given)


def test_tools_are_declared_with_their_arguments():
    from skyloom.plans.tools import TOOLS, declarations

    told = {d["name"]: d["parameters"] for d in declarations()}
    assert told.keys() == TOOLS.keys() and all(p["additionalProperties"] is False for p in told.values())
    assert told["station_detail"]["required"] == ["station"]
    assert told["forecast"]["properties"]["hours"] == {"type": "integer", "description": "How far ahead to read.", "minimum": 1, "maximum": 72, "default": 72}
    assert told["fire_corridor"]["properties"]["since"]["format"] == "date"
    assert "o3" in told["index_rules"]["properties"]["pollutant"]["enum"]
