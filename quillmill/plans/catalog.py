"""All registered queries of the core library, with their SQL."""

from __future__ import annotations

from quillmill.plans import answers, arrays, classify, dedup, evaluation, relational, sources, text, tokens

_MODULES = (text, dedup, tokens, classify, evaluation, answers, arrays, relational, sources)

QUERIES = {name: q for m in _MODULES for name, q in m.query.queries.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.query.oracles.items()}
