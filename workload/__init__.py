"""Registered queries: each library operator applied to the whole driver tables."""

import importlib

MODULES = ("tables", "filters", "joins", "aggregates", "ranks", "functions", "studies", "processes", "fits")


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"workload.{name}")
