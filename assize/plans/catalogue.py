"""All registered queries and their SQL."""

from __future__ import annotations

from assize.plans import audits, classifiers, curated, curation, entities, links, rates, representation, series, serving, streams, subjects

_PARTS = (rates, series, entities, serving, streams, curated, subjects, classifiers, curation, representation, links, audits)
QUERIES = {name: query for part in _PARTS for name, query in part.R.queries.items()}
ORACLE_SQL = {name: sql for part in _PARTS for name, sql in part.R.sql.items()}
