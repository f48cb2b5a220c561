"""Operators over DataFrames: index upkeep, crawl graph, retrieval, assembly, reports, conversations."""
