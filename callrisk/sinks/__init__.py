"""Sinks: result, metric and model writers, CRM upsert, per-agent push."""
