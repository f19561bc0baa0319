"""Landing of raw snapshots as they arrive."""
