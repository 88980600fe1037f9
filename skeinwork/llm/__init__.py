"""Training-data operators: ten corpus-scale steps over documents, pages and labels."""
