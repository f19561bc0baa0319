"""Readers of landed files, manifests, and idempotent writes."""
