"""Training-data operators: tokens, packing, near-duplicates, mixing, quality, chat formatting, sharding and language-model scores."""
