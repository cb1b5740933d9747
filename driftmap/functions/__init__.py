"""Part of driftmap."""
