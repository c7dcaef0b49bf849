from .aggregate import Daily, Flat, Keyed, daily_features, flat_features, keyed_features, slice_stats
from .categories import Category, category_counts, category_values, fit_manifest, listed_cells, listed_counts, long_counts, wide_counts
from .frequent import (
    hot_value_counts,
    hot_value_split,
    label_skewed_values,
    listed_value_counts,
    values_in_band,
)
from .skew import HOT_ROWS, grouped_medians, split_hot

__all__ = [
    "Flat",
    "Daily",
    "Keyed",
    "Category",
    "flat_features",
    "daily_features",
    "keyed_features",
    "slice_stats",
    "category_counts",
    "category_values",
    "long_counts",
    "wide_counts",
    "fit_manifest",
    "listed_cells",
    "listed_counts",
    "values_in_band",
    "hot_value_split",
    "hot_value_counts",
    "listed_value_counts",
    "label_skewed_values",
    "split_hot",
    "grouped_medians",
    "HOT_ROWS",
]
