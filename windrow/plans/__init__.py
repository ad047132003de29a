"""plans of windrow."""
