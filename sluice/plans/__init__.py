"""Query plans over the registered tables."""

from . import activity, curation, domain, joins, normalize, reports, retention, samplers, sources, statistics, streams, topics

MODULES = [activity, joins, statistics, normalize, domain, curation, streams, reports, retention, samplers, sources, topics]
