"""Tenant ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_TENANT = "default"


def tenant_of(name: str = "tenant_id") -> Column:
    """The tenant a row belongs to: null and empty ids mean the default tenant; case counts."""
    return F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(DEFAULT_TENANT))


def valid_tenant(c: Column) -> Column:
    """1 to 128 bytes, no leading dot, not ``*``, no separators or control characters."""
    return (
        (F.octet_length(c) >= 1)
        & (F.octet_length(c) <= 128)
        & ~c.startswith(".")
        & (c != "*")
        & ~c.rlike(r"[/\\\x00-\x1f\x7f]")
        & (c != "api_keys.json")
    )
