"""Table-level operators: detection, configuration, transforms, pseudonyms, audit."""
