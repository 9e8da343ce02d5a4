"""ANSI SQL twins of the registered queries, over the same parquet views.

Each twin is written from the definition of the query, not from the Spark plan.
`ctes` holds the shared sub-selects; `with_ctes` prepends those a text refers to.
"""
