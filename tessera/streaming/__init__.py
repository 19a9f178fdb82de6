"""Event-time forms of watching, debouncing and failure tracking; batch and stream run the same functions."""
