"""Bindings of operators to the driver tables, one module per operator family."""

from importlib import import_module

MODULES = (
    "sources",
    "projections",
    "joins",
    "aggregates",
    "sequences",
    "text",
    "quality",
    "inference",
    "modeling",
    "regression",
    "resampling",
    "streams",
)


def load_all() -> None:
    for module in MODULES:
        import_module(f"{__name__}.{module}")
