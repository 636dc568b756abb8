"""Part of codestrata; see the README for the map of modules."""
