"""Questions by name with typed parameters, for callers that don't write DataFrames.

Each tool states its arguments: type, default, range, pattern or choices. ``ask`` checks what it is given against these before
anything runs, and hands texts to SQL as named parameters, never as a part of it. ``declarations`` is the same as JSON
schemas, for a caller that has to be told.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tables as T
from ..sources.bridge import pixels, stations, steady
from . import relations
from .geography import FI
from .series import REG as SERIES
from .series import h_small


class Refused(ValueError):
    """A question that can't be asked as it stands."""


@dataclass(frozen=True)
class Argument:
    kind: str  # string, integer or date
    says: str
    default: object = None
    required: bool = False
    low: int | None = None
    high: int | None = None
    choices: tuple[str, ...] = ()

    def checked(self, name: str, value: object) -> object:
        """The value as the tool takes it; Refused if it isn't one."""
        if value is None:
            if self.required:
                raise Refused(f"{name} is required")
            return self.default
        if self.kind == "integer":
            if isinstance(value, bool) or not isinstance(value, int):
                raise Refused(f"{name} must be a whole number")
            if (self.low is not None and value < self.low) or (self.high is not None and value > self.high):
                raise Refused(f"{name} must be from {self.low} to {self.high}")
            return value
        if not isinstance(value, str) or not value.strip():
            raise Refused(f"{name} must be a text")
        if self.kind == "date":
            try:
                if dt.date.fromisoformat(value).isoformat() != value:
                    raise ValueError
            except ValueError:
                raise Refused(f"{name} must be a day, written yyyy-mm-dd") from None
        if self.choices and value not in self.choices:
            raise Refused(f"{name} must be one of {', '.join(self.choices)}")
        return value

    def schema(self) -> dict[str, object]:
        kind = {"type": "string", "format": "date"} if self.kind == "date" else {"type": self.kind}
        more = {"minimum": self.low, "maximum": self.high, "enum": list(self.choices) or None, "default": self.default}
        return kind | {"description": self.says} | {k: v for k, v in more.items() if v is not None}


@dataclass(frozen=True)
class Tool:
    says: str
    answer: Callable[..., DataFrame]
    arguments: Mapping[str, Argument] = field(default_factory=dict)

    def declaration(self, name: str) -> dict[str, object]:
        needed = [n for n, a in self.arguments.items() if a.required]
        parameters = {"type": "object", "properties": {n: a.schema() for n, a in self.arguments.items()}, "required": needed, "additionalProperties": False}
        return {"name": name, "description": self.says, "parameters": parameters}


def city_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: the worst and the mean index of all valid station hours."""
    return relations.indexed(spark, sf_dir).agg(F.max("aqi").alias("worst"), steady(F.avg("aqi")).alias("mean"))


def station_detail(spark: SparkSession, sf_dir: str, station: str) -> DataFrame:
    """The last hour of the station of that name, else of the first whose name holds the text; no row without one."""
    found = spark.sql(
        """SELECT id, name, provider, lat, lon FROM {places}
        WHERE lower(name) = lower(trim(:station)) OR contains(lower(name), lower(trim(:station)))
        ORDER BY lower(name) <> lower(trim(:station)), id LIMIT 1""",
        args={"station": station},
        places=stations(spark, sf_dir),
    )
    last = h_small(spark, sf_dir).groupBy(F.col("station_id").alias("id")).agg(F.max(F.struct("hour", "value")).alias("t"))
    joined = found.join(last, "id", "left")
    return joined.select("id", "name", "provider", "lat", "lon", F.col("t.hour").alias("hour"), F.col("t.value").alias("value"))


def forecast(spark: SparkSession, sf_dir: str, hours: int) -> DataFrame:
    """The network's mean at every sixth lead up to so many hours."""
    leads = relations.f1(spark, sf_dir).where((F.col("lead") <= hours) & (F.col("lead") % 6 == 0))
    return leads.groupBy("lead").agg(steady(F.avg("value")).alias("mean"), steady(F.max("value")).alias("worst"))


def fire_corridor(spark: SparkSession, sf_dir: str, since: str | None) -> DataFrame:
    """Fires by latitude band and rough state, from a day on."""
    rows = pixels(spark, sf_dir)
    if since:
        rows = spark.sql("SELECT * FROM {fires} WHERE acq_date >= :since", args={"since": since}, fires=rows)
    return FI.regions(rows)


def policy_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stage that the city's worst day puts in force."""
    return SERIES.queries["a6_policy_city"](spark, sf_dir)


def inversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of each zone."""
    return relations.a32(spark, sf_dir)


def city_history(spark: SparkSession, sf_dir: str, days: int) -> DataFrame:
    """One row over the last so many days of the table: how many there are, their mean, the best and the worst."""
    d = h_small(spark, sf_dir).groupBy(F.col("hour").cast("date").alias("day")).agg(steady(F.avg("value")).alias("v"))
    text = """SELECT count(*) AS days, avg(v) AS mean, min(struct(v, day)).day AS best, max(struct(v, day)).day AS worst
        FROM {daily} WHERE datediff((SELECT max(day) FROM {daily}), day) < :days"""
    return spark.sql(text, args={"days": days}, daily=d).withColumn("mean", steady(F.col("mean")))


def index_rules(spark: SparkSession, sf_dir: str, pollutant: str | None) -> DataFrame:
    """How many hours each pollutant is averaged over, and how many of them must be there."""
    rows = [(p, T.NAMES[p], h, T.LEAST_HOURS[h]) for p, h in T.AVERAGING_HOURS.items() if pollutant in (None, p)]
    return spark.createDataFrame(rows, "pollutant string, name string, hours int, least_hours int")


TOOLS: dict[str, Tool] = {
    "city_now": Tool("What the instruments read just now, over all valid stations: the worst index and the mean.", city_now),
    "station_detail": Tool(
        "One station's last reading, by its name or a part of it.",
        station_detail,
        {"station": Argument("string", "The name, or a text that it holds.", required=True)},
    ),
    "forecast": Tool(
        "The forecast of the network's mean and its worst station, every six hours.",
        forecast,
        {"hours": Argument("integer", "How far ahead to read.", default=72, low=1, high=72)},
    ),
    "fire_corridor": Tool(
        "Fire detections by latitude band and state: where smoke comes from.",
        fire_corridor,
        {"since": Argument("date", "The first day to count; all days without it.")},
    ),
    "policy_stage": Tool("The stage of the action plan in force, set by the worst day.", policy_stage),
    "inversion": Tool("Where air is held near the ground: alerts by zone.", inversion),
    "city_history": Tool(
        "The last days of the record: how many, their mean, the best and the worst.",
        city_history,
        {"days": Argument("integer", "How many days back.", default=30, low=1, high=30)},
    ),
    "index_rules": Tool(
        "How many hours each pollutant is averaged over and how many must be there.",
        index_rules,
        {"pollutant": Argument("string", "One pollutant; all without it.", choices=tuple(T.AVERAGING_HOURS))},
    ),
}


def declarations() -> list[dict[str, object]]:
    """All tools with their arguments as JSON schemas."""
    return [tool.declaration(name) for name, tool in TOOLS.items()]


def ask(spark: SparkSession, sf_dir: str, name: str, **parameters: object) -> DataFrame:
    """The answer of a tool by its name. Unknown names and parameters, wrong types and values out of range are Refused."""
    if name not in TOOLS:
        raise Refused(f"no tool is named {name}; there are {', '.join(sorted(TOOLS))}")
    tool = TOOLS[name]
    if unknown := sorted(set(parameters) - set(tool.arguments)):
        raise Refused(f"{name} takes no {', '.join(unknown)}")
    given = {n: a.checked(n, parameters.get(n)) for n, a in tool.arguments.items()}
    return tool.answer(spark, sf_dir, **given)
