"""Registered queries, one module per family."""

from importlib import import_module

FAMILIES = ("sources", "projections", "joins", "aggregates", "supervision", "windows", "sorting",
            "scalars", "detection", "models", "text", "governance", "streams")


def load():
    for name in FAMILIES:
        import_module(f"{__name__}.{name}_q")
    return import_module(f"{__name__}.registry")
