"""What every job sets up first: the session, one seed and the log."""

from __future__ import annotations

import logging
import random
import sys
from datetime import datetime
from pathlib import Path

import numpy as np
from pyspark.sql import SparkSession

LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR")


def session(name: str = "tessera") -> SparkSession:
    """The running session, or one with the cluster's own settings."""
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()


def set_seed(seed: int = 42) -> int:
    """One seed for the driver's generators; estimators take the returned value."""
    random.seed(seed)
    np.random.seed(seed % (1 << 32))
    return seed


def setup_logging(log_dir: str | None = "logs", level: str = "INFO") -> str | None:
    """Log to standard output and, if a folder is given, to a file named by the time; returns its path."""
    if level not in LEVELS:
        raise ValueError(f"unknown log level {level!r}")
    handlers: list[logging.Handler] = [logging.StreamHandler(sys.stdout)]
    path = None
    if log_dir:
        Path(log_dir).mkdir(parents=True, exist_ok=True)
        path = str(Path(log_dir) / f"run_{datetime.now():%Y%m%d_%H%M%S}.log")
        handlers.append(logging.FileHandler(path, encoding="utf-8"))
    logging.basicConfig(level=level, format="%(asctime)s %(levelname)s %(name)s: %(message)s", handlers=handlers, force=True)
    logging.getLogger("py4j").setLevel(logging.WARNING)
    return path
