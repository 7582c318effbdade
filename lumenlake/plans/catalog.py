"""All queries of the core, by name, with their SQL oracles."""

from . import bookkeeping, corpus, media, scalars, service, similarity

QUERIES = {**similarity.R.queries, **media.R.queries, **bookkeeping.R.queries, **scalars.R.queries, **service.R.queries, **corpus.QUERIES}
ORACLE = {**similarity.R.oracle, **media.R.oracle, **bookkeeping.R.oracle, **scalars.R.oracle, **service.R.oracle, **corpus.ORACLE}
