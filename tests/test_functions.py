"""Boundary cases of the Column functions, with expectations worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from skyloom.functions import geo as G
from skyloom.functions import index as X
from skyloom.functions import parse as P
from skyloom.functions import tables as T
from skyloom.functions import weather as W


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def num(v):
    return F.lit(v).cast("double")


@pytest.mark.parametrize("pollutant, c, want", [("pm25", 60, 100), ("pm25", 90, 200), ("pm10", 100, 100), ("co", 2, 100), ("o3", 168, 200), ("pm25", 30, 50), ("pm25", 30.05, 51), ("pm25", 900, 500), ("pm25", -5, None), ("pm25", None, None), ("pm25", 0, 0)])
def test_sub_index(spark, pollutant, c, want):
    assert one(spark, X.sub_index(pollutant, num(c))) == want


def test_every_band_edge_is_held_by_the_lower_band(spark):
    cases = [(p, hi, b) for p, bands in T.SUB_INDEX.items() for _, hi, _, b in bands]
    got = spark.range(1).select(*[X.sub_index(p, num(c)).alias(f"x{i}") for i, (p, c, _) in enumerate(cases)]).first()
    assert list(got) == [b for _, _, b in cases]


def test_inverse_of_the_index_gives_the_index_back(spark):
    rows = spark.range(0, 500).select("id", X.sub_index("pm25", X.pm25_of_index(F.col("id"))).alias("again")).collect()
    assert all(r["id"] == r["again"] for r in rows)


@pytest.mark.parametrize("pm, want", [(30.0, 50), (30.04, 50), (30.06, 51), (350, 500), (450, 599), (-4, 0)])
def test_policy_index(spark, pm, want):
    assert one(spark, X.policy_index(num(pm))) == want


def test_ingest_index_gaps_and_ties(spark):
    got = one(spark, X.ingest_index(num(30.05), num(100.0), num(80.0), num(None)))
    assert (got["aqi"], got["dominant"]) == (100.0, "PM10")
    assert one(spark, X.ingest_index(num(30.05), num(None), num(None), num(None)))["aqi"] is None


@pytest.mark.parametrize("aqi, stage", [(200, 0), (201, 1), (300, 1), (400, 2), (450, 3), (451, 4)])
def test_policy_stage(spark, aqi, stage):
    assert one(spark, X.policy_stage(F.lit(aqi)))["stage"] == stage


@pytest.mark.parametrize(
    "pollutant, value, unit, want",
    [("no2", 1, "ppb", 1.8816), ("o3", 1, "ppm", 1963.06), ("co", 1, "ppm", 1.1456), ("co", 1000, "µg/m³", 1.0), ("co", 1000, "μg/m3", 1.0), ("pm25", 5, " UG / M3", 5.0), ("pm25", 1, "ppb", None), ("pm25", 1, "furlong", None), ("no2", 2, "mg/m3", 2000.0)],
)
def test_units(spark, pollutant, value, unit, want):
    got = one(spark, P.to_index_unit(F.lit(pollutant), num(value), F.lit(unit)))
    assert got == (want if want is None else pytest.approx(want, rel=1e-4))


@pytest.mark.parametrize("raw, want", [("45.678", 45.68), ("120.5", 120.5), ("-999", None), ("inf", None), ("nan", None), ("x", None), (None, None), ("1501", None)])
def test_number(spark, raw, want):
    assert one(spark, P.number(F.lit(raw).cast("string"), 0, 1500)) == want


@pytest.mark.parametrize("raw, want", [(" 12 ", 12.0), ("NA", None), ("n/a", None), ("-", None), ("", None), ("-3", None), ("0", 0.0)])
def test_bulletin_number(spark, raw, want):
    assert one(spark, P.bulletin_number(F.lit(raw))) == want


@pytest.mark.parametrize("day, hhmm, want", [("2025-11-05", "709", dt.datetime(2025, 11, 5, 7, 9)), ("2025-11-05", "709.0", dt.datetime(2025, 11, 5, 7, 9)), ("2025-11-05", "noon", dt.datetime(2025, 11, 5)), ("2025-11", "0709", None), (None, "0709", None), ("2025-11-05", "2561", None)])
def test_detected_at(spark, day, hhmm, want):
    assert one(spark, P.detected_at(F.lit(day).cast("string"), F.lit(hhmm)).cast("timestamp_ntz")) == want


def test_bulletin_moment_is_local_time(spark):
    assert one(spark, P.bulletin_moment(F.lit("19-09-2026 18:00:00")).cast("timestamp_ntz")) == dt.datetime(2026, 9, 19, 12, 30)


@pytest.mark.parametrize("day, burning", [("2025-11-05", True), ("2025-10-20", True), ("2025-10-10", True), ("2025-10-02", False), ("2026-09-20", False)])
def test_season(spark, day, burning):
    assert (one(spark, P.season_hint(F.lit(day).cast("date"))) == "burning season") == burning


def test_names(spark):
    n = F.lit("Sector - 125, Noida, UP - UPPCB")
    assert one(spark, P.agency(n, F.lit("x"))) == "UPPCB"
    assert one(spark, P.display_name(n)) == "Sector - 125, Noida"
    assert one(spark, P.agency(F.lit("Pusa, Delhi - ABCD"), F.lit("cpcb"))) == "CPCB"
    assert one(spark, P.short_name(F.lit("Anand Vihar, Delhi, Delhi, India"))) == "Anand Vihar"
    assert one(spark, P.short_name(F.lit(None).cast("string"))) == "Unknown"


def test_redaction(spark):
    got = one(spark, P.redacted(F.lit("https://example.org/api/area/csv/KEY/x?api-key=a&token=b c")))
    assert "KEY" not in got and "api-key=REDACTED&token=REDACTED c" in got


@pytest.mark.parametrize("pbl, wind, trap, risk", [(280, 1.2, True, "CRITICAL"), (1400, 4.5, False, "LOW"), (450, 2.4, False, "HIGH"), (900, 3.0, False, "MODERATE"), (None, 1, False, "UNKNOWN")])
def test_dispersion(spark, pbl, wind, trap, risk):
    got = one(spark, W.dispersion(num(pbl), num(wind)))
    assert (got["inversion"], got["risk"]) == (trap, risk)


def test_feedback_signs_limits_and_identity(spark):
    rows = spark.range(0, 1200, 50).select(F.col("id").cast("double").alias("pm"))
    off, on = W.coupled(F.col("pm"), num(300), num(800), num(20)), W.coupled(F.col("pm"), num(300), num(800), num(20), amplify=True)
    got = rows.select("pm", *[c.alias(k) for k, c in off.items()], on["pm25_out"].alias("more")).orderBy("pm").collect()
    assert all(r["pm25_out"] == r["pm"] and r["more"] >= r["pm"] and r["aod"] <= 3.5 and r["pbl_out"] >= 50 and 0 <= r["solar_out"] <= 300 for r in got)
    assert [r["solar_out"] for r in got] == sorted((r["solar_out"] for r in got), reverse=True)


def test_regions_are_tried_in_order(spark):
    assert one(spark, G.ingest_region(num(30.25), num(75.85))) == "Punjab"
    assert one(spark, G.rough_state(num(30.0), num(76.6))) == "Punjab"
    assert one(spark, G.latitude_band(num(28.92))) == "lower corridor"


def test_bearing_compass_and_wind(spark):
    assert one(spark, G.bearing_deg(num(28.0), num(77.0), 29.0, 77.0)) == pytest.approx(0.0)
    assert [one(spark, G.compass(num(d))) for d in (0, 11.24, 11.26, 359.9)] == ["N", "N", "NNE", "N"]
    u, v = G.wind_parts(num(5), num(0))
    assert one(spark, u) == pytest.approx(0) and one(spark, v) == pytest.approx(-5)
    assert one(spark, G.wind_block(num(None), num(1))) is None


@pytest.mark.parametrize(("u", "v", "to", "back"), [(0.0, -0.0, "S", "N"), (-0.0, -0.0, "S", "N"), (0.0, 0.0, "N", "S"), (-0.0, 0.0, "N", "S")])
def test_wind_block_of_a_calm(spark, u, v, to, back):
    w = spark.createDataFrame([(u, v)], "u double, v double").select(G.wind_block(F.col("u"), F.col("v")).alias("w")).first()["w"]
    assert (w["to_compass"], w["from_compass"], w["speed_ms"]) == (to, back, 0.0)


def test_transit_outcomes(spark):
    lat, lon = num(30.9), num(75.85)
    to = G.bearing_deg(lat, lon, *T.TARGET)
    assert one(spark, G.transit(lat, lon, to, num(12)))["carrying"] is True
    assert one(spark, G.transit(lat, lon, to + 180, num(12)))["carrying"] is not True
    assert one(spark, G.transit(lat, lon, to, num(1)))["carrying"] is False
    assert one(spark, G.transit(lat, lon, num(None), num(None)))["carrying"] is None


def test_utm_against_known_points(spark):
    e, n = G.utm(num(0.0), num(75.0))
    assert one(spark, e) == pytest.approx(500000.0, abs=1e-6) and one(spark, n) == pytest.approx(0.0, abs=1e-6)
    e, n = G.utm(num(28.6139), num(77.2090))
    assert one(spark, e) == pytest.approx(715919, abs=400) and one(spark, n) == pytest.approx(3167190, abs=1500)


@pytest.mark.parametrize("minutes, want", [(0, "1m"), (59.9, "59m"), (60, "1h"), (1439, "23h"), (1440, "1d")])
def test_age(spark, minutes, want):
    assert one(spark, W.age_text(num(minutes))) == want
