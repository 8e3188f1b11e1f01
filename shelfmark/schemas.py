"""Declared table types. Empty CSV cells are read as NULL, never as text in a numeric column."""

from pyspark.sql import types as T

_S, _D, _L, _I = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


PRODUCTS_CSV = _struct(
    product_id=_L, parent_asin=_S, main_category=_S, product_title=_S, average_rating=_D,
    rating_number=_L, features_json=_S, product_description=_S, price=_D, images_json=_S,
    videos_json=_S, store=_S, categories_json=_S, details_json=_S, bought_together_json=_S,
    brand=_S, color=_S, product_locale=_S,
)

PRODUCTS = T.StructType(PRODUCTS_CSV.fields + [T.StructField("filters_json", _S)])

REVIEWS = _struct(
    parent_asin=_S, rating=_D, review_title=_S, review_text=_S, images_json=_S, user_id=_S,
    review_ts=T.TimestampNTZType(), helpful_vote=_L, verified_purchase=_I, marketplace=_S,
    category=_S,
)

JUDGED_QUERIES = _struct(
    example_id=_S, query=_S, query_id=_S, product_id=_S, product_locale=_S, esci_label=_S,
    small_version=_I, large_version=_I, split=_S,
)

FILTER = _struct(
    filter_column=_S, filter_type=_S, value=_S, min=_D, max=_D, total_in_db=_L,
    match_count=_L, match_percentage=_D,
)

VECTORS = _struct(product_id=_L, parent_asin=_S, vector=T.ArrayType(T.FloatType()))
