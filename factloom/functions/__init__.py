"""Part of the factloom engine; see README.md."""
