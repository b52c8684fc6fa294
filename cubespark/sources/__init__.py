"""Reading and writing cell tables."""
