"""Operators of a training-data pipeline: tokenisation, web archives,
packing, chat formatting, search, classification, de-duplication,
fingerprints, secret and personal-data scans.

One module per operator, each with its general interface; ``queries`` has
the registered ``opN_<name>`` query of every operator and its DuckDB SQL
where one exists. Nothing outside this package imports it.
"""
