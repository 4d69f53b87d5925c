"""Structured Streaming versions, beyond what batch parity needs."""
