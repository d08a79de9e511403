"""The registered queries, one module for each family of operators."""

from importlib import import_module

FAMILIES = ("texts", "graphs", "vectors", "states", "functions", "building", "research", "sources", "streams")


def load() -> None:
    for family in FAMILIES:
        import_module(f"folium.plans.{family}")
