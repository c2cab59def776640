"""Operators for preparing language-model training data at cluster scale.

Nothing outside this subpackage imports it; the entry module adds its queries only when it can
be imported.
"""
