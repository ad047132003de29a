"""functions of windrow."""
