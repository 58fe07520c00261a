"""All registered queries, by section."""

from importlib import import_module

from tabulon.plans.catalog.base import ORACLES, QUERIES

SECTIONS = ("tables", "cleaning", "grouping", "analyses", "modelling", "comparing", "texts")

for _name in SECTIONS:
    import_module(f"tabulon.plans.catalog.{_name}")

__all__ = ["ORACLES", "QUERIES"]
