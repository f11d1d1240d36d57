"""The models: staging, enriched events, marts, pattern checks and the load jobs."""
