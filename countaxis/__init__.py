"""Grouped count-signal analytics on Spark: sparse per-entity counts along an ordered axis, aggregated, tested, smoothed,
resampled, modelled by hidden Markov chains and called into groups."""
