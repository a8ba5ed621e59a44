"""lapforge: DataFrame-to-DataFrame operators for lap, result, weather and text tables."""
