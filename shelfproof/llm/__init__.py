"""Operations of a training-data pipeline over whole corpora.

Each module holds one operator, DataFrame to DataFrame; ``queries`` registers
them over the driver tables.  Nothing else in the library imports this folder.
"""
