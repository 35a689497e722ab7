"""Table and stream operators for audio signals, song catalogs and request logs."""
