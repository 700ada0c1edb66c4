"""Training-data operators: near duplicates, chat formatting, packing, language models, filters, decontamination, PII."""
