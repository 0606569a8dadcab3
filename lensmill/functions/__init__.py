"""Part of lensmill; see README.md."""
