"""The library's pipelines as streams."""
