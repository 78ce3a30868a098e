"""Raw tables: schemas, readers, the test-table mapping and sinks."""
