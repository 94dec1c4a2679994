"""Column functions: object ids over canonical JSON, paths, sizes and renderings."""
