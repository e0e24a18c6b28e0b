"""Sensitive-text analytics on Spark: detection, fail-closed gating and protected record streams."""
