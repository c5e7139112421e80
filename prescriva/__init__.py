"""Prescriptive analytics on tabular data as Spark jobs.

A table is profiled, given a semantic schema, encoded and scaled; a fuzzy cognitive map
is learned from it and iterated to a fixed point; and for each record below its goal the
smallest change of its actions is sought that moves the map's outcome there.
"""
