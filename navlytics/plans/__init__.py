"""Multi-operator jobs: tracking statistics, map maintenance, matching and map refinement."""
