"""Identity-verification and AML case analytics as Spark jobs over all tenants and cases at once."""
