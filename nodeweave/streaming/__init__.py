"""Feeding a graph from Structured Streaming."""

from nodeweave.streaming.ingest import edges_into, nodes_into

__all__ = ["edges_into", "nodes_into"]
