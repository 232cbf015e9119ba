"""The query catalogue."""

from docflow.plans import activity_queries, annotation_queries, layout_queries, search_queries, streaming_queries, structure_queries, viewer_queries
from docflow.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "activity_queries", "annotation_queries", "layout_queries", "search_queries", "streaming_queries", "structure_queries", "viewer_queries"]
