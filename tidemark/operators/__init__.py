"""Operators over versioned histories: as-of joins, lifetimes, snapshots, validation."""
