"""Sources: batches of records, lists, provider payloads and stored state."""
