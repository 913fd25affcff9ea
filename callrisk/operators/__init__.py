"""DataFrame -> DataFrame operators (chain with ``df.transform``)."""
