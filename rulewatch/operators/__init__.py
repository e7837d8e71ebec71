"""DataFrame operators: joins, grouping, history and the findings engine."""
