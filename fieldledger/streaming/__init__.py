"""Incremental feeds (R01-R03, batch with saved state) and streams."""
