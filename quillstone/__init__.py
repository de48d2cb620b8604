"""quillstone: set-at-a-time retrieval, hygiene and packing of typed text memories on Spark."""

__version__ = "0.1.0"
