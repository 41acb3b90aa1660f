"""Tables: the catalog of versioned snapshots, and delimited files."""
