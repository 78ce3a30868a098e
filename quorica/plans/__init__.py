"""Assembly of the operators into a forum workspace."""
