"""Registered queries with the DuckDB SQL that states the same result."""

import importlib

MODULES = ("q_core", "q_outcomes", "q_trends", "q_sets", "q_tables", "q_ml")


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"checks.{name}")
