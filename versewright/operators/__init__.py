"""DataFrame -> DataFrame operators of the verse corpus."""
