"""Incremental forms of the listing ingest and of the submission counts."""
from .listing import ingest_listing_stream
from .submissions import submissions_stream, weekly_table

__all__ = ["ingest_listing_stream", "submissions_stream", "weekly_table"]
