"""Incident analytics on Spark: normalize, score, summarize, ground, retrieve, alert."""
