"""Registered queries: a Spark callable and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from registry.base import ALL, SQL, load_all

__all__ = ["ALL", "SQL", "load_all"]
