"""Registered queries over the driver's tables, by family."""

from importlib import import_module

FAMILIES: tuple[str, ...] = ("aggregates", "joins", "ordered", "scalars", "statistics", "streams", "embedded", "extras", "formats", "columns")


def load() -> None:
    """Imports every family, which registers its queries."""
    for name in FAMILIES:
        import_module(f"helixframe.plans.{name}")
