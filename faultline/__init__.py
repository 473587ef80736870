"""faultline package."""
