"""Training-data operators (quality, tokenizing, decontamination, licences,
near-dedup, extraction, token files, substring dedup, sharding, secrets).

``queries()`` and ``oracle_sql()`` list the thin ``opN_<name>`` queries and the
``pipeline``; the operators keep their own interfaces in the modules.
"""

from __future__ import annotations

from tessera.llm import registry


def queries():
    return registry.queries()


def oracle_sql():
    return registry.oracle_sql()
