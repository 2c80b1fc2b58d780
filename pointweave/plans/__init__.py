"""Planning rules, estimates and admission checks as columns."""
