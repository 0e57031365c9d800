"""Published scales, factors and names that results must equal."""

from __future__ import annotations

# --- fixed values: index bands as (concentration from, to, index from, to) ---
SUB_INDEX = {
    "pm25": [(0, 30, 0, 50), (30, 60, 51, 100), (60, 90, 101, 200), (90, 120, 201, 300), (120, 250, 301, 400), (250, 500, 401, 500)],
    "pm10": [(0, 50, 0, 50), (50, 100, 51, 100), (100, 250, 101, 200), (250, 350, 201, 300), (350, 430, 301, 400), (430, 600, 401, 500)],
    "no2": [(0, 40, 0, 50), (40, 80, 51, 100), (80, 180, 101, 200), (180, 280, 201, 300), (280, 400, 301, 400), (400, 1000, 401, 500)],
    "so2": [(0, 40, 0, 50), (40, 80, 51, 100), (80, 380, 101, 200), (380, 800, 201, 300), (800, 1600, 301, 400), (1600, 2400, 401, 500)],
    "nh3": [(0, 200, 0, 50), (200, 400, 51, 100), (400, 800, 101, 200), (800, 1200, 201, 300), (1200, 1800, 301, 400), (1800, 2400, 401, 500)],
    "pb": [(0, 0.5, 0, 50), (0.5, 1.0, 51, 100), (1.0, 2.0, 101, 200), (2.0, 3.0, 201, 300), (3.0, 3.5, 301, 400), (3.5, 5.0, 401, 500)],
    "o3": [(0, 50, 0, 50), (50, 100, 51, 100), (100, 168, 101, 200), (168, 208, 201, 300), (208, 748, 301, 400), (748, 1000, 401, 500)],
    "co": [(0, 1.0, 0, 50), (1.0, 2.0, 51, 100), (2.0, 10, 101, 200), (10, 17, 201, 300), (17, 34, 301, 400), (34, 50, 401, 500)],
}
GAPPED = {
    "pm25": [(0.0, 30.0, 0, 50), (30.1, 60.0, 51, 100), (60.1, 90.0, 101, 200), (90.1, 120.0, 201, 300), (120.1, 250.0, 301, 400), (250.1, 500.0, 401, 500)],
    "pm10": [(0.0, 50.0, 0, 50), (50.1, 100.0, 51, 100), (100.1, 250.0, 101, 200), (250.1, 350.0, 201, 300), (350.1, 430.0, 301, 400), (430.1, 600.0, 401, 500)],
    "nox": [(0.0, 40.0, 0, 50), (40.1, 80.0, 51, 100), (80.1, 180.0, 101, 200), (180.1, 280.0, 201, 300), (280.1, 400.0, 301, 400), (400.1, 600.0, 401, 500)],
    "o3": [(0.0, 50.0, 0, 50), (50.1, 100.0, 51, 100), (100.1, 168.0, 101, 200), (168.1, 208.0, 201, 300), (208.1, 748.0, 301, 400), (748.1, 1000.0, 401, 500)],
}
POLICY_PM25 = [(0.0, 30.0, 0, 50), (30.1, 60.0, 51, 100), (60.1, 90.0, 101, 200), (90.1, 120.0, 201, 300), (120.1, 250.0, 301, 400), (250.1, 350.0, 401, 500)]
CLIENT_PM25 = [(0, 30, 0, 50), (30, 60, 51, 100), (60, 90, 101, 200), (90, 120, 201, 300), (120, 250, 301, 400), (250, 1000, 401, 500)]
FOREIGN = {
    "pm25": [(0.0, 12.0, 0, 50), (12.1, 35.4, 51, 100), (35.5, 55.4, 101, 150), (55.5, 150.4, 151, 200), (150.5, 250.4, 201, 300), (250.5, 350.4, 301, 400), (350.5, 500.4, 401, 500)],
    "pm10": [(0, 54, 0, 50), (55, 154, 51, 100), (155, 254, 101, 150), (255, 354, 151, 200), (355, 424, 201, 300), (425, 504, 301, 400), (505, 604, 401, 500)],
    "o3": [(0, 54, 0, 50), (55, 70, 51, 100), (71, 85, 101, 150), (86, 105, 151, 200), (106, 200, 201, 300)],
}
CATEGORIES = [(50, "Good"), (100, "Satisfactory"), (200, "Moderate"), (300, "Poor"), (400, "Very Poor"), (500, "Severe")]
POLLUTANTS = ["pm25", "pm10", "no2", "o3", "so2"]
NAMES = {"pm25": "PM2.5", "pm10": "PM10", "no2": "NO2", "so2": "SO2", "nh3": "NH3", "pb": "Pb", "co": "CO", "o3": "O3"}
AVERAGING_HOURS = {"pm25": 24, "pm10": 24, "no2": 24, "so2": 24, "nh3": 24, "pb": 24, "co": 8, "o3": 8}
LEAST_HOURS = {24: 16, 8: 6}
# --- fixed values: grams per mole, litres per mole at 25 degrees ---
MOLAR_MASS = {"no2": 46.0055, "so2": 64.066, "o3": 47.997, "co": 28.010, "nh3": 17.031}
MOLAR_VOLUME = 24.45
# --- fixed values: channels as (name, unit, offset, scale, scale of the older vector) ---
CHANNELS = [
    ("pm25", "ug/m3", 0.0, 1000.0, 500.0),
    ("pm10", "ug/m3", 0.0, 1500.0, 700.0),
    ("o3", "ug/m3", 0.0, 500.0, 120.0),
    ("no2", "ug/m3", 0.0, 400.0, 250.0),
    ("u_wind", "m/s", 10.0, 20.0, 20.0),
    ("v_wind", "m/s", 10.0, 20.0, 20.0),
    ("temperature", "C", 10.0, 60.0, 40.0),
    ("humidity", "%", 0.0, 100.0, 100.0),
    ("solar", "W/m2", 0.0, 1200.0, 1200.0),
    ("pbl", "m", 0.0, 4000.0, 3000.0),
    ("frp", "MW", 0.0, 200.0, 200.0),
    ("smoke", "index", 0.0, 300.0, 300.0),
]
# --- fixed values: places, boxes as (south, north, west, east) ---
GRID = {"rows": 70, "cols": 80, "south": 28.20, "north": 28.90, "west": 76.80, "east": 77.60}
CENTRE = (28.6289, 77.2065)
CENTRAL_KM = 7.0
CITY_BOX = (28.40, 28.90, 76.84, 77.35)
TARGET = (28.60, 77.21)
NEAR_BOX = (28.20, 28.92, 76.80, 77.62)
EARTH_KM = 6371.0088
KM_LAT, KM_LON = 111.0, 97.5
POINTS = ["N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW"]
INGEST_REGIONS = [
    ("Punjab", 29.5, 32.5, 74.0, 76.8),
    ("Haryana", 27.5, 30.8, 75.8, 77.8),
    ("Western UP", 26.5, 30.5, 77.5, 80.5),
    ("Delhi NCR", 28.3, 28.9, 76.8, 77.5),
]
AGENCIES = ["CPCB", "DPCC", "IMD", "ICAR", "HSPCB", "UPPCB", "IITM", "NEERI"]
PLACE_WORDS = ["delhi", "new delhi", "india", "uttar pradesh", "up", "haryana"]
LAST_PLACES = ["delhi", "new delhi", "up", "uttar pradesh"]
FIRE_TYPES = {0: "vegetation", 1: "volcano", 2: "other static land", 3: "offshore"}
# --- fixed values: policy stages as (index up to, stage, category, actions) ---
STAGES = [
    (200, 0, "Moderate or Better", ["No emergency GRAP measures active.", "Follow regular pollution control protocols."]),
    (300, 1, "Poor", ["Strict enforcement of dust mitigation measures.", "Ban on open burning of garbage.", "Restrict use of DG sets."]),
    (
        400,
        2,
        "Very Poor",
        ["Ban on use of coal and firewood in tandoors in hotels/restaurants.", "Enhance parking fees to discourage private transport.", "Increase frequency of mechanized sweeping and water sprinkling on roads."],
    ),
    (450, 3, "Severe", ["Strict ban on construction and demolition activities in NCR.", "Ban on BS III petrol and BS IV diesel vehicles.", "Close down operations of stone crushers and brick kilns."]),
    (
        None,
        4,
        "Severe+",
        [
            "Stop entry of truck traffic into Delhi (except essential commodities).",
            "Ban on construction in linear public projects (highways, roads, flyovers).",
            "State Governments may consider odd-even scheme for vehicles.",
            "Closure of educational institutions and implementation of WFH.",
        ],
    ),
]
