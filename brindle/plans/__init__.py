"""From syntax tree to DataFrame: names and types are bound, predicates rewritten, and the plan is declared."""
