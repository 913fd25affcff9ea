"""Structured Streaming operators for live call sessions and their batch twins."""
