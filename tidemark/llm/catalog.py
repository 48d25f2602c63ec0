"""Queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from tidemark.llm import bpe, html_extract, line_dedup, mixing, neighbours, quality_rules, secret_scan, simhash, substring_dedup, token_files

_ALL = {
    "op1_line_dedup": (line_dedup.query, line_dedup.ORACLE_SQL),
    "op2_simhash": (simhash.query, None),
    "op9_bpe": (bpe.query, None),
    "op10_mixing": (mixing.query, None),
    "op3_html_extract": (html_extract.query, None),
    "op4_token_files": (token_files.query, None),
    "op5_substring_dedup": (substring_dedup.query, substring_dedup.ORACLE_SQL),
    "op6_quality_rules": (quality_rules.query, quality_rules.ORACLE_SQL),
    "op7_secret_scan": (secret_scan.query, None),
    "op8_neighbours": (neighbours.query, None),
}


def queries() -> dict:
    return {name: f for name, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
