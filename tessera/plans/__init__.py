"""Plan inspection: size estimates behind broadcast decisions and checks on
physical plans (pushed filters, no Python UDF, no cartesian product)."""
