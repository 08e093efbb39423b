"""Streaming twins: cursors by partition, lookback, merging sinks."""
