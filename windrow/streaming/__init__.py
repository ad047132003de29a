"""streaming of windrow."""
