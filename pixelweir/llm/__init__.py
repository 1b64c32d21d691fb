"""Training-data operators: dedup, extraction, redaction, filtering and token counting at corpus scale."""
