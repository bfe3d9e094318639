"""Training-data operators.  Self-contained: nothing outside this subpackage imports it."""
