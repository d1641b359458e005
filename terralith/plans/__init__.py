"""Named queries over the driver's tables, each with the same result in DuckDB SQL where SQL can express it."""
