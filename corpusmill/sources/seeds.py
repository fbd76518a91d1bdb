"""Seed urls by area from YAML text."""

from __future__ import annotations

from pathlib import Path
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession


def load_seeds(path: str, allowed: tuple[str, ...]) -> dict[str, list[str]]:
    """area → urls; the whole load fails on the first url of a host that isn't allowed."""
    import yaml

    areas = (yaml.safe_load(Path(path).read_text()) or {}).get("seeds") or {}
    for area, urls in areas.items():
        for url in urls or []:
            if (urlsplit(url).hostname or "").lower() not in allowed:
                raise ValueError(f"seed of area {area} isn't on an allowed host: {url}")
    return {area: list(urls or []) for area, urls in areas.items()}


def seed_frame(spark: SparkSession, seeds: dict[str, list[str]]) -> DataFrame:
    """area, url in the file's order."""
    return spark.createDataFrame([(a, u) for a, urls in seeds.items() for u in urls], "area string, url string")
