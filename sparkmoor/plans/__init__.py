"""Composed plans: the step protocol and the registered query catalogue."""
