"""sources of windrow."""
