"""DataFrame operators: the customer-summary layers, joins, mapping, lineage
and data-quality transforms."""
