"""Column helpers and the few vectorised helpers."""
