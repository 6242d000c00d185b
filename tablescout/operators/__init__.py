"""DataFrame operators: profiling, indexing, search, audit, questions, run scoring."""
