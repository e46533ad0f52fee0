"""DataFrame operators: segments, daily statistics, detectors, calibration, spectra, modes, events, models."""
