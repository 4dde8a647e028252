"""Pure ``DataFrame -> DataFrame`` operators; nothing here writes or collects unbounded data."""
