"""Training-data operators: dedup, secrets, WARC, extraction, quality, URL rules, mixing, token files, decontamination."""
