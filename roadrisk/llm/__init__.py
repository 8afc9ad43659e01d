"""Training-data operators: dedup, scans, mixing, packing, token output.

Nothing else in the library imports this subpackage."""
