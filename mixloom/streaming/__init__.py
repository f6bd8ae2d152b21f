"""Scoring of streams; there is no other streaming operator."""
