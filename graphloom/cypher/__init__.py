"""Statement text to frozen dataclasses."""
