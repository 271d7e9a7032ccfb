"""Registry of the corpus queries and of their SQL twins."""

from __future__ import annotations

from gridloom.llm import apportion, bin_packing, chat_format, chosen_path, fertility, ivf_pq, lattice_lm, quality_gam, secret_ledger, toxic_neighbours

MODULES = (lattice_lm, toxic_neighbours, chat_format, secret_ledger, apportion, quality_gam, fertility, chosen_path, bin_packing, ivf_pq)

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
