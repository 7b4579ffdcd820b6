"""Training-data operators: cleaning, deduplication, scans, scoring and encoding.

Nothing else in the library imports this subpackage."""
