"""Training-data operators: formatting, counting, dedup, filtering, mixing and packing."""
