"""evidencelake: DataFrame operators for collections of research papers.

Every operator takes and returns Spark DataFrames (or Columns) and works for all
questions, papers and documents at once.
"""
