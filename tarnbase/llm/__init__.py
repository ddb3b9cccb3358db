"""Training-data operators: quality, deduplication, decontamination, privacy, archives and mixing."""
