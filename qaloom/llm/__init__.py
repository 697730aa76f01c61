"""Training-data operators: cleaning, deduplication, filtering and tokenizing of documents."""
