"""DataFrame operators, one module a family of analyses."""
