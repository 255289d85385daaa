"""Writers: files, snapshots, triples and reports."""
