"""Registered queries: the library's operators over the derived tables, each with its oracle."""

from wattspark.plans import aggregations, filters, functions, joins, kernels, more, recordings, relations, series, sets, stalls, streams, writes

__all__ = ["aggregations", "filters", "functions", "joins", "kernels", "more", "recordings", "relations", "series", "sets", "stalls", "streams", "writes"]
