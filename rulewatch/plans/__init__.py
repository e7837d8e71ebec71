"""The daily run, reports, charts, life cycle and configuration checks."""
