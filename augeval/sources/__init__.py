"""Sources and sinks: pruned CSV scans, nested run records, prediction folders, ordered table writes, manifests."""
