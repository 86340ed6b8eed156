"""Training-data operators: filters, classifiers, near-duplicates, search, tokens, mixing."""
