"""Question-and-answer post analytics on Spark DataFrames.

``functions``  column expressions (text, HTML, vectors)
``sources``    readers and writers
``operators``  DataFrame -> DataFrame building blocks
``plans``      the end-to-end jobs, each one lazy plan
"""
