"""A PySpark-native event ledger: typed envelopes, wildcard subscriptions, an append-only ledger with exact cursors, bounded drains."""
