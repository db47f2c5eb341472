"""Operators that prepare training corpora. Nothing else in pagewright imports this subpackage."""
