"""Point-in-time analytics over immutable, versioned key/value history, on Spark."""
