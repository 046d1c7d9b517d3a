"""The analysis kernel: graphs as tables, propagation to a fixpoint, findings."""
