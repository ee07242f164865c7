"""Queries that bind the operators to the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("interval_queries", "asof_queries", "frame_queries", "label_queries", "fold_queries", "text_queries", "cut_queries", "song_queries", "classify_queries", "alignment_queries", "structure_queries", "duration_queries", "archive_queries")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    for name in MODULES:
        import_module(f"cuesheet.plans.{name}")
    return import_module("cuesheet.plans.registry").QUERIES


def oracle_sql() -> dict[str, str]:
    queries()
    return import_module("cuesheet.plans.registry").SQL
