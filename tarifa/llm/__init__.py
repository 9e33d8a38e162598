"""Training-data operators: language id, decontamination, toxicity, packing,
substring dedup, token counts, media payloads, n-gram joins, HTML, chat."""
