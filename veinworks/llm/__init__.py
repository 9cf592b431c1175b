"""Operators for preparing language-model training data at corpus scale.

Each module holds one operator with a general DataFrame interface. `entries`
registers the thin ``opN_<name>`` queries that apply them to whole tables.
Nothing outside this subpackage imports it.
"""
