"""DataFrame operators: pairing by key, comparison, duplicates, lookups, numbering, loads."""
