"""Schemas, enumerations and limits of the code-graph model."""

#: Fixed values of the model.
NODE_KINDS = ("file", "symbol", "package", "route", "schema")
EDGE_KINDS = ("contains", "declares", "imports", "requires", "references", "calls", "extends", "implements", "handles-route", "depends-on", "tests", "reads-schema", "writes-schema")
#: Kinds of nodes that a query may ask for: those of the first version as well.
ASKED_KINDS = (*NODE_KINDS, "document")
IMPACT_KINDS = ("imports", "requires", "references", "calls", "tests")
STRUCTURE_KINDS = ("contains", "declares")
PROVENANCES = ("EXTRACTED", "INFERRED", "AMBIGUOUS")

#: Default and largest budgets of a graph query.
MAX_COST, MAX_RESULTS, MAX_DEPTH = (10_000, 50_000), (50, 500), (8, 20)
