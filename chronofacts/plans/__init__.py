"""Multi-step plans and the registered query workload."""
