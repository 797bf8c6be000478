"""DataFrame-to-DataFrame operators: parsing, folding, linking, indexing and reporting."""
