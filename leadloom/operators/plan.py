"""Acquisition plans as tables of queries."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PRIORITY = {"high": 0, "medium": 1, "low": 2}
TARGET = "plan string, country string, country_code string, segment string, priority string, target int, keywords array<string>, cities array<string>"


def load_plan(folder: str, name: str) -> dict:
    """A plan of the folder by name; a name can't lead out of it. Keywords are kept once, whatever their case."""
    import yaml

    path = (Path(folder) / f"{name}.yaml").resolve()
    if path.parent != Path(folder).resolve():
        raise ValueError(f"{name} is outside the folder of plans")
    plan = yaml.safe_load(path.read_text("utf-8"))
    extra = set(plan) - {"name", "country", "industry", "cities", "targets"}
    if extra or not plan.get("targets"):
        raise ValueError(f"unknown keys {sorted(extra)}" if extra else "a plan needs targets")
    for t in plan["targets"]:
        missing = [c for c in t.get("cities", []) if c not in plan["cities"]]
        if missing or t.get("priority", "medium") not in PRIORITY:
            raise ValueError(f"a target has unknown cities {missing} or priority {t.get('priority')}")
        t["keywords"] = list({k.strip().casefold(): k.strip() for k in reversed(t["keywords"])}.values())[::-1]
    return plan


def plan_targets(spark: SparkSession, plan: dict) -> DataFrame:
    c = plan["country"]
    rows = [(plan.get("name"), c["name"], c["code"], t["segment"], t.get("priority", "medium"), i, t["keywords"], [plan["cities"][x]["name"] for x in t["cities"]]) for i, t in enumerate(plan["targets"])]
    return spark.createDataFrame(rows, TARGET)


def expand(targets: DataFrame) -> DataFrame:
    """One row for each target, city and keyword, numbered in the order in which they run: by priority, then as written."""
    rank = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])[F.col("priority")]
    one = targets.withColumn("rank", rank).select("*", F.posexplode("cities").alias("city_at", "city"))
    one = one.select("*", F.posexplode("keywords").alias("keyword_at", "keyword"))
    return one.select("plan", "country", "country_code", "segment", "priority", "city", "keyword", F.struct("rank", "target", "city_at", "keyword_at").alias("run_order"))


def without_completed(queries: DataFrame, runs: DataFrame) -> DataFrame:
    keys = ["plan", "segment", "keyword", "country_code", "city"]
    return queries.join(runs.where("status = 'completed'").select(*keys), keys, "left_anti")
