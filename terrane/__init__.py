"""A declarative data engine on PySpark: relations, queries, integrity rules, policies and change plans."""
