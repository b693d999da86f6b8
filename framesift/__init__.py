"""framesift: frame selection, question-answer scoring and corpus preparation on Spark."""
