"""All queries by name, with their SQL."""

from ostinato.plans import audits, corpus, events, full_records, generation, granularities, harmony, records, reviews, rhythm, runs, selections, suspicions, trusted, validators

_MODULES = (rhythm, harmony, events, records, corpus, reviews, selections, generation, granularities, validators, runs, trusted, audits, full_records, suspicions)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
