"""Part of the weftgraph engine; see README.md for the map of modules."""
