"""Registered queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

from importlib import import_module

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
MODULES = ("quality_q", "simhash_q", "mixing_q", "passages_q", "tokens_q", "decontam_q", "langid_q", "toxicity_q", "secrets_q", "licenses_q", "vector_codes_q", "minhash_q", "spelling_q")


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""

    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return deco


def load():
    for name in MODULES:
        import_module(f"{__package__}.{name}")
    return QUERIES, ORACLES
