"""DataFrame operators: quality rules, temporal joins, ranking and event folds."""
