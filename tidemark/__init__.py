"""Tidemark: detections, crossings and their event log on Spark."""
