"""Training-data operators: search, decontamination, PII, de-duplication, quality, packing, licences, toxicity."""
