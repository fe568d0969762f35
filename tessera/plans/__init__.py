"""Plans: snapshot store, run orchestration, release, catalog."""
