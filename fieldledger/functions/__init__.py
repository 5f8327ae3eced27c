"""Column-level functions: text, contacts, pay, clinical tags, versions, notes, labels, predicates."""
