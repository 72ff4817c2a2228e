"""Registered queries: operators bound to the provided tables by role."""

import importlib

_MODULES = ("calendar_events", "marks", "study", "resampling", "series", "weather", "documents",
            "catalog", "audit", "accounts", "forecast", "streams", "landed", "facts")


def load() -> None:
    for name in _MODULES:
        importlib.import_module(f"{__name__}.{name}")
