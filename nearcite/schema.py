"""Column names and Spark types of the corpus and its two source tables."""

from pyspark.sql import types as T

_LINK = T.ArrayType(T.StructType([T.StructField("publication_number", T.StringType())]))
_VALUE = T.StructType([T.StructField("value", T.StringType())])
_NAMES = T.ArrayType(
    T.StructType([T.StructField("name", T.StringType()), T.StructField("country", T.StringType())])
)

CORPUS = T.StructType(
    [
        T.StructField("publication_number", T.StringType()),
        T.StructField("application_number", T.StringType()),
        T.StructField("filing_date", T.IntegerType()),
        T.StructField("publication_date", T.IntegerType()),
        T.StructField("grant_date", T.IntegerType()),
        T.StructField("title", _VALUE),
        T.StructField("abstract", _VALUE),
        T.StructField("embedding_v1", T.ArrayType(T.DoubleType())),
        T.StructField("cited_by", _LINK),
        T.StructField("citation", _LINK),
        T.StructField("parent", _LINK),
        T.StructField("child", _LINK),
        T.StructField("assignee_harmonized", _NAMES),
        T.StructField("inventor_harmonized", _NAMES),
        T.StructField("primary_assignee", T.StringType()),
        T.StructField("primary_inventor", T.StringType()),
        T.StructField("cpc", T.ArrayType(T.StructType([T.StructField("code", T.StringType())]))),
        T.StructField("top_terms", T.ArrayType(_VALUE)),
    ]
)
CORPUS_COLUMNS = CORPUS.fieldNames()

# The four link arrays, in the order in which a row's links are read.
LINK_COLUMNS = ("citation", "cited_by", "parent", "child")

# What a search returns next to the distance: everything but the vector.
SEARCH_COLUMNS = [c for c in CORPUS_COLUMNS if c != "embedding_v1"]
# What an expanded neighbour carries.
NEIGHBOR_COLUMNS = [c for c in SEARCH_COLUMNS if c != "application_number"]
