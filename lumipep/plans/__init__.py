"""Bindings of the driver's tables to the domain, and the registered queries with their SQL."""
