"""Training-data operators: quality, de-duplication, tokenisation, packing and scoring."""
