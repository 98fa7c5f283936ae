"""End-to-end runs composed of operators, on tables with the columns listed in `daymark.plans.sources`."""
