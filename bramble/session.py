"""Session factory and the engine's settings."""

from __future__ import annotations

import logging

from pyspark.sql import SparkSession

#: setting -> (default, accepted values; None: a non-negative whole number)
SETTINGS = {
    "engine.execution": ("true", ("true", "false")),
    "engine.min_rows": ("524288", None),
    "engine.log_level": ("warn", ("trace", "debug", "info", "warn", "error", "critical", "off")),
    "engine.groupby_path": ("auto", ("auto", "hash", "sort")),
}
LEVELS = {"trace": 5, "debug": logging.DEBUG, "info": logging.INFO, "warn": logging.WARNING, "error": logging.ERROR, "critical": logging.CRITICAL, "off": logging.CRITICAL + 10}
log = logging.getLogger("bramble")


def session(app: str = "bramble", master: str | None = None, **conf: str) -> SparkSession:
    """A session for analytics: UTC, adaptive execution; sizes are left to the cluster unless given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
    }
    for key, value in (base | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def set_option(spark: SparkSession, name: str, value: object) -> None:
    """Set an engine setting; an unknown name or value raises, naming what is accepted."""
    key = name if name.startswith("engine.") else f"engine.{name}"
    if key not in SETTINGS:
        raise ValueError(f"unknown setting {name!r}; settings: {', '.join(sorted(SETTINGS))}")
    accepted = SETTINGS[key][1]
    text = str(value).lower()
    if accepted is None:
        if not text.isdigit():
            raise ValueError(f"{key} takes a non-negative whole number, not {value!r}")
    elif text not in accepted:
        raise ValueError(f"{key} takes one of {', '.join(accepted)}, not {value!r}")
    spark.conf.set(key, text)
    if key == "engine.log_level":
        log.setLevel(LEVELS[text])


def get_option(spark: SparkSession, name: str) -> str:
    key = name if name.startswith("engine.") else f"engine.{name}"
    if key not in SETTINGS:
        raise ValueError(f"unknown setting {name!r}; settings: {', '.join(sorted(SETTINGS))}")
    return spark.conf.get(key, SETTINGS[key][0])
