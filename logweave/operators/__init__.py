"""DataFrame -> DataFrame operators: mining, pool/matching, sampling,
verification, scoring, lints, splitting, set operations."""
