"""DataFrame operators: lookup, dispatch, graph, coverage, metrics, regularity, regimes."""
