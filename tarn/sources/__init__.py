"""Where tables are read from: storage, Avro documents, loaders and scans."""
