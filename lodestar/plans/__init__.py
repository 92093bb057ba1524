"""Query catalogue: every operator bound to the driver's tables, with the SQL it is checked against."""
