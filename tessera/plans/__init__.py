"""Query registry and the named queries."""
