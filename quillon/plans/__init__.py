"""From a request to a DataFrame."""
