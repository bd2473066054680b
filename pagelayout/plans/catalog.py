"""Collects the registered queries."""

from __future__ import annotations

from pagelayout.plans.registry import Query, all_queries
from pagelayout.plans import align_queries, geometry_queries, job_queries, layout_queries, page_queries, stream_queries, text_queries
from pagelayout.plans.layout_queries import page_summary

__all__ = ["page_summary", "registered"]


def registered() -> dict[str, Query]:
    return all_queries()
