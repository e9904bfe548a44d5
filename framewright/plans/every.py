"""All queries of the engine: importing a module of queries registers them."""

from __future__ import annotations

from framewright.plans import alignments, catalogue, formats, models, reports, selections, signals

MODULES = (alignments, catalogue, formats, models, reports, selections, signals)
QUERIES, SQL, FLAGSHIP = catalogue.QUERIES, catalogue.SQL, catalogue.FLAGSHIP
