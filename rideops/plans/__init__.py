from rideops.plans import community_queries, driver_queries, frame_queries, hotspot_queries, outcome_queries, source_queries, stream_queries, tendency_queries, zone_queries

ALL_QUERIES = {
    **zone_queries.QUERIES, **frame_queries.QUERIES, **tendency_queries.QUERIES, **driver_queries.QUERIES,
    **hotspot_queries.QUERIES, **outcome_queries.QUERIES, **source_queries.QUERIES, **community_queries.QUERIES, **stream_queries.QUERIES,
}
