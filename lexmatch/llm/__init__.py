"""Training-data operators: extraction, packing, decontamination, scoring, scans, dedup, formats, sharding."""
