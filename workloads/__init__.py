"""Stand-in inputs on the driver tables, the registered queries, and their reference SQL."""
