"""File stores and repositories: scans, ignore rules, sinks, the object table and its root pointer."""
