"""Training-data operators: quality, de-duplication, scoring, mixing and packing of documents."""
