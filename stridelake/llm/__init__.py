"""Training-data operators: token counts, binary output, dedup, decontamination, scans and archives."""
