"""Values the result depends on.

Fixed values: column orders, word lists, patterns, formats and thresholds below must stay as they
are, because the produced tables and filters are defined by them.
"""

# Output column order of the cleaned product table.
PRODUCT_COLUMNS = [
    "product_id", "parent_asin", "main_category", "product_title", "average_rating",
    "rating_number", "features_json", "product_description", "price",
    "images_json", "videos_json", "store", "categories_json", "details_json",
    "bought_together_json", "brand", "color", "product_locale",
]

# Output column order of the cleaned review table.
REVIEW_COLUMNS = [
    "parent_asin", "rating", "review_title", "review_text", "images_json",
    "user_id", "review_ts", "helpful_vote", "verified_purchase",
    "marketplace", "category",
]

# File name prefix that marks product metadata files.
PRODUCT_FILE_PREFIX = "meta_"

# Words read as booleans, compared in lower case.
TRUE_WORDS = ["true", "1", "y", "yes", "t"]
FALSE_WORDS = ["false", "0", "n", "no", "f"]

# First number inside a price text.
PRICE_PATTERN = r"[-+]?\d*\.?\d+"

# Texts that count as an empty cell (the last two in any case).
EMPTY_WORDS = ["", "[]", "{}", "null", "nan"]

# Filter kind per product column, in output order.
FILTER_KINDS = {
    "main_category": "exact_match",
    "product_title": "NER_contains",
    "store": "exact_match",
    "average_rating": "range",
    "rating_number": "range",
    "price": "range",
    "features_json": "json_contains",
    "details_json": "json_contains",
}

# Range filters aim at these shares of the column's values, in percent.
TARGET_SELECTIVITIES = [0.1, 1.0, 10.0, 50.0]

# Edges of the selectivity bands, in percent; a band is open below and closed above.
BAND_EDGES = [0.01, 0.1, 1.0, 10.0, 50.0, 70.0]

# Entity labels that do not make a useful phrase (for plugged-in taggers).
SKIPPED_ENTITY_LABELS = ["CARDINAL", "ORDINAL"]

# Vector run defaults.
PAGE_SIZE = 512
BATCH_SIZE = 64
WINDOW_TOKENS = 64
WINDOW_OVERLAP = 10
SPECIAL_TOKENS = 2
REVIEWS_PER_PRODUCT = 20
MIN_DOCUMENT_CHARS = 20
NORM_EPSILON = 1e-12
POOL_EPSILON = 1e-6

# Header of the duplicate report.
DUPLICATE_COLUMNS = ["section", "product_id", "files", "counts_by_file"]
