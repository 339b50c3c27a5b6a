"""What changes a table: appends, overwrites, schema changes, transactions."""
