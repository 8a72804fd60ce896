"""Suppression of small cells, as SQL expressions."""

from __future__ import annotations


def mask_count(count: str, min_count: int) -> str:
    """``count``, or the marker ``-min_count`` when fewer than ``min_count`` persons stand behind it."""
    return f"if({count} < {min_count}, -{min_count}L, {count})"


def mask_value(value: str, count: str, min_count: int) -> str:
    """``value``, or NULL when fewer than ``min_count`` persons stand behind it."""
    return f"if({count} < {min_count}, NULL, {value})"
