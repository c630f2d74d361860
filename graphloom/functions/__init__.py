"""Statistics, checks and text helpers."""
