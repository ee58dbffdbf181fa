"""Jobs over long tables of ordered events, waveforms and scores."""
