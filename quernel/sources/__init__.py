"""Tables: definitions, immutable Parquet snapshots, and the catalog that names them."""
