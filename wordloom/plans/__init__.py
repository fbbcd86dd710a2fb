"""End-to-end plans over the test tables: each builds one DataFrame lazily."""
