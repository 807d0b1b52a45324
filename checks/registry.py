"""All registered queries."""

from __future__ import annotations

from importlib import import_module

MODULES = ["players", "teams", "lineups", "prospects", "draft", "units", "ingest"]


def _all(attr: str) -> dict:
    out = {}
    for name in MODULES:
        out.update(getattr(import_module(f"checks.{name}"), attr))
    return out


def queries() -> dict:
    return _all("Q")


def oracles() -> dict:
    return _all("O")
