"""Specifications, the catalog, and the compiler."""
