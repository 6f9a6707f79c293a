from oracle import community, drivers, frames, hotspots, outcomes, sources, streaming, tendency, zone_bins

ALL_STATEMENTS = {}
for _module in (zone_bins, frames, tendency, drivers, outcomes, sources, hotspots, community, streaming):
    ALL_STATEMENTS.update(_module.statements())
