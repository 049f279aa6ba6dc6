"""Planning helpers: the shared folder, lineage cuts and checked broadcasts."""
