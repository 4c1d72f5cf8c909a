"""Training-data operators: PII, decontamination, sharding, binary output, dedup, quality, packing, WARC."""
