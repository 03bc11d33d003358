"""Registered queries, grouped by the kind of table they read."""

from __future__ import annotations

from importlib import import_module

GROUPS = ("candle_queries", "trade_queries", "report_queries", "research_queries", "book_queries", "ledger_queries", "source_queries", "stream_queries")


def all_registries() -> list:
    return [import_module(f"tickloom.plans.{name}").R for name in GROUPS]
