"""All queries of this subpackage, and their SQL."""

from __future__ import annotations

from ridgeline.llm import chat, decontaminate, html_blocks, materialise, near_dedup, neighbours, packing, quality, secrets, toxicity

MODULES = (html_blocks, packing, chat, materialise, decontaminate, neighbours, near_dedup, toxicity, quality, secrets)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL = {name: s for m in MODULES for name, s in m.SQL.items()}
