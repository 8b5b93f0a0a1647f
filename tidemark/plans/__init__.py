"""Table layout and its commit protocol: manifests, levels, compaction, garbage collection."""
