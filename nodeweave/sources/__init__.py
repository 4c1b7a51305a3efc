"""Catalogs of node and edge tables, and the stores that keep them."""
