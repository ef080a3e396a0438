"""Planning helpers: shared storage, freezing, decorrelation."""
