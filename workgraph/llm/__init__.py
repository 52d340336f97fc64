"""Training-data operators: extraction, counting, de-duplication, filtering, mixing and encoding of documents."""
