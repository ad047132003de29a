"""operators of windrow."""
