"""Identifier expressions: strategy ids, wire symbols and name-based UUIDs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Namespace of name-based instrument ids, and the id prefixes of rows
# written by test runs.
ID_NAMESPACE = "8f3a1c02-6b77-4b1e-9a5d-2e0c4f816a3b"
TEST_PREFIXES = ("smoke-test-", "restart-test-")


def strategy_kind(strategy_id: Column) -> Column:
    """Text after the last ``::``, or the whole id."""
    return F.substring_index(strategy_id, "::", -1)


def instance_id(robot: Column, kind: Column) -> Column:
    return F.concat_ws("::", robot, kind)


def is_test_strategy(strategy_id: Column) -> Column:
    flag = F.lit(False)
    for prefix in TEST_PREFIXES:
        flag = flag | strategy_id.startswith(prefix)
    return flag


def asset_code(text: Column) -> Column:
    return F.upper(F.trim(text))


def wire_symbol(pair: Column) -> Column:
    """``BASE/QUOTE`` to ``BASEQUOTE``."""
    return F.upper(F.replace(F.trim(pair), F.lit("/"), F.lit("")))


def name_uuid(name: Column, namespace: str = ID_NAMESPACE) -> Column:
    """Version-5 UUID of a name, from a SHA-1 expression (no Python UDF)."""
    space = F.unhex(F.lit(namespace.replace("-", "")))
    digest = F.sha1(F.concat(space, F.encode(name, "utf-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )
