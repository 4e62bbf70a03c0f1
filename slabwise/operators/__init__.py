"""Set-oriented operators over blob tables, indexes and operation logs."""
