"""Training-data operators over document tables. Nothing outside this subpackage imports it."""
