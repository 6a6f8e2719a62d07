"""Column-expression builders (no UDFs): predicates, bands, labels, cleaning, numerics."""
