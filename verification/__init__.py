"""Queries over the test tables, each with a SQL twin, one module per operator family."""

from verification import expressions, panels, pipeline, places, ranking, relations, roundtrips, spatial, stages, statistics

CASE_MODULES = (expressions, relations, ranking, statistics, panels, spatial, pipeline, roundtrips, stages, places)
