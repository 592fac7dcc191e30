"""Training-data operators: one module each, their queries in :mod:`arbora.llm.queries`."""
