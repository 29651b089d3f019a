"""Every checked query with its SQL twin."""

from __future__ import annotations

from importlib import import_module

PARTS = ("ranking", "chunks", "records", "answers", "studying", "layout", "streams", "whole")


def _merged(name: str) -> dict:
    merged: dict = {}
    for part in PARTS:
        merged.update(getattr(import_module(f"passagework.catalog.{part}"), name))
    return merged


def queries() -> dict:
    return _merged("QUERIES")


def oracles() -> dict[str, str]:
    return _merged("ORACLES")
