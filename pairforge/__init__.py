"""pairforge: Spark jobs that build, prepare and score corpora of question-query pairs."""

__version__ = "0.1.0"
