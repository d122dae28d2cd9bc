"""Part of Tessera; see the modules."""
