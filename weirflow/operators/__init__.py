"""DataFrame operators: records, filters, state, loading."""
