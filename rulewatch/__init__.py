"""Recurring, rule-based data checks as Spark jobs.

``functions`` are Column helpers, ``operators`` turn DataFrames into DataFrames,
``sources`` read and write tables, ``rules`` is the rule catalogue and ``plans``
joins them into the daily run, the reports, the charts and the life-cycle jobs.
"""
