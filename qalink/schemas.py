"""Table schemas. Every reader states its schema, so no scan is spent on inference."""

from pyspark.sql import types as T


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


STRING, LONG, INT, DOUBLE = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()

POSTS = _table(question_id=LONG, answer_id=LONG, title=STRING, body=STRING, tags=STRING)
SIMILARITIES = _table(question_id=LONG, answer_id=LONG, title=STRING, category=STRING, similarity=DOUBLE)
SELECTED_POSTS = _table(question_id=LONG, category=STRING, mean_similarity=DOUBLE)
LIBRARIES_SELECTED = _table(category=STRING, url=STRING)
LIBRARIES_DETAILS = _table(group_id=STRING, artifact_id=STRING, version=STRING)
LIBRARY_INFO = _table(name=STRING, url=STRING)
LIBRARY_VERSIONS = _table(group_id=STRING, artifact_id=STRING, versions=STRING)
USAGES = _table(answer_id=LONG, title=STRING, libraries=STRING)
BIGRAMS = _table(tag_a=STRING, tag_b=STRING, label_a=INT, label_b=INT)
VECTORS = _table(word=STRING, vector=T.ArrayType(T.FloatType()))
SYMBOLS = _table(
    group_id=STRING, artifact_id=STRING, version=STRING, class_name=STRING, member_name=STRING, ord=LONG
)
LEXICON = _table(token=STRING, tag=STRING)
POST_CLASS_SPLIT = T.StructType(
    [
        T.StructField("class", STRING),
        T.StructField("category", STRING),
        T.StructField("len", LONG),
        T.StructField("total", LONG),
    ]
)
ARCHIVE_ENTRIES = _table(path=STRING, entry=STRING, is_dir=T.BooleanType())
