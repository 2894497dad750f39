"""DataFrame operators: scorers, aggregates, comparisons, quality checks, costs."""
