"""Operators for building training corpora: one module for each, all free of
imports from the rest of the package.  ``queries.py`` registers the thin
``opN_*`` queries."""
