"""A small formula language over bars, compiled to staged plans."""
