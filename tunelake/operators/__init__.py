"""DataFrame-to-DataFrame building blocks: lookups, ranking, concentration, upserts, tests."""
