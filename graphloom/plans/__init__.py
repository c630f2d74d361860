"""From statements to DataFrame plans."""
