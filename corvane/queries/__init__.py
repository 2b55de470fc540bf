"""The registered queries of the document-graph engine, each with its SQL form."""
