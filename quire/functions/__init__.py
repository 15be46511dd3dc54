"""Part of Quire; see the modules."""
