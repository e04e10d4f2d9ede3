"""Loads every query module and hands out the registry."""
import importlib

from tocsin.plans import registry

MODULES = ["series_queries", "label_queries", "composite_queries", "spatial_queries", "ingest_queries", "stream_queries", "study_queries"]


def _load():
    for m in MODULES:
        importlib.import_module(f"tocsin.plans.{m}")


def queries():
    _load()
    return dict(registry.QUERIES)


def oracle_sql():
    _load()
    return dict(registry.ORACLES)
