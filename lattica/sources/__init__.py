"""Where facts come from: tables, source trees, commit logs."""
