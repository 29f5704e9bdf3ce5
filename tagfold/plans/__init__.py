"""Which query answers which operator, and the SQL that must agree."""
