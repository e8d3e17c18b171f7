"""Column lists and schemas (as DDL text) of the tables the library reads and writes.

Fixed values: names, types and order of columns are those of the data.
"""

from __future__ import annotations

#: Columns every review table has, in this order.
REVIEW_COLUMNS = ["text", "rating", "title", "asin", "product_category"]

REVIEW_SCHEMA = (
    "text STRING, rating DOUBLE, title STRING, asin STRING, product_category STRING"
)
POOL_SCHEMA = "id STRING, text STRING, title STRING, asin STRING, product_category STRING"
SCORED_SCHEMA = POOL_SCHEMA + ", p_neg DOUBLE, p_neu DOUBLE, p_pos DOUBLE"
CANDIDATE_SCHEMA = (
    POOL_SCHEMA + ", rating DOUBLE, pred_label INT, probs ARRAY<DOUBLE>, uncertainty DOUBLE"
)
GOLD_SCHEMA = CANDIDATE_SCHEMA + ", label INT"
TODO_SCHEMA = POOL_SCHEMA + ", label STRING"
