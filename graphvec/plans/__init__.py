"""End-to-end jobs composed from operators (walk + train + save, and the
evaluation grid) and the registry of named queries."""
