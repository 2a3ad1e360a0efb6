"""Sources and sinks: JSON configuration, file sets, tensors."""
