"""The table format's documents as Python values: schemas, specs, snapshots, manifests."""
