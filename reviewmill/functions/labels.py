"""Lookups from small fixed tables, and the labels shown to readers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from reviewmill import constants as C


def lookup(key: Column, table: dict, default: Column) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.create_map(*pairs)[key], default)


def priority(severity: Column) -> Column:
    return lookup(severity, C.SEVERITY_PRIORITY, F.lit(C.DEFAULT_PRIORITY))


def severity_rank(severity: Column) -> Column:
    return lookup(severity, C.SEVERITY_RANK, F.lit(C.DEFAULT_SEVERITY_RANK))


def severity_label(severity: Column) -> Column:
    return lookup(severity, C.SEVERITY_LABEL, severity)


def sentiment_badge(sentiment: Column) -> Column:
    return lookup(F.coalesce(sentiment, F.lit(C.DEFAULT_SENTIMENT)), C.SENTIMENT_BADGE, F.lit(""))


def sentiment_icon(sentiment: Column) -> Column:
    return lookup(
        F.coalesce(sentiment, F.lit(C.DEFAULT_SENTIMENT)), C.SENTIMENT_ICON, F.lit(C.DEFAULT_ICON)
    )


def is_negative(recommended: Column) -> Column:
    """Only an explicit "not recommended" counts; a missing answer does not."""
    return F.coalesce(~recommended, F.lit(False))


def recommend_flag(recommended: Column) -> Column:
    return F.when(is_negative(recommended), C.NOT_RECOMMENDED_FLAG).otherwise(C.RECOMMENDED_FLAG)
