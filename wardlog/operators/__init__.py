"""DataFrame operators: formats, normalisers, detectors, aggregates, queries."""
