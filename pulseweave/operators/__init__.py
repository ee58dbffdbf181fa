"""DataFrame operators: events, shuffles, metrics, cohorts, templates, distances, waveforms and signal quality."""
