"""Column-level building blocks: catalogues, regex translation, expressions."""
