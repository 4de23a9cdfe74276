"""Training-data operators: packing, quality, extraction, deduplication, decontamination, licences."""
