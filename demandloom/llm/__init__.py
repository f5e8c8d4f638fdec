"""Training-data operators over document, vector and web-page tables."""
