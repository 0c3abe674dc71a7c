from lorefield.llm import pii

# a smaller labelled table keeps the tests short; the model stays good enough for what they ask
pii.ROWS, pii.EPOCHS = 9000, 5
