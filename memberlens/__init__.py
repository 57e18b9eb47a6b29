"""Member-analytics marts expressed as PySpark DataFrame jobs.

``sources``    the input tables, by role, from a catalog, a folder or the sample data
``functions``  column expressions: keys, labels, measures
``operators``  blocks shared by several marts: identity, contacts, orders, visits
``plans``      one function per mart and the list of all marts
``sinks``      full refresh of a written mart
"""
