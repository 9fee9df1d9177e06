"""Common URL functions by name, for queries written as SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from mediaweave import constants as K
from mediaweave.functions.urls import any_of

_SPLIT = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def _raw(pattern: str) -> str:
    return "r'" + pattern.replace("'", r"\x27") + "'"


def _part(n: int) -> str:
    return f"regexp_extract(url, {_raw(_SPLIT)}, {n})"


_PATH = f"regexp_replace({_part(3)}, ';[^/]*$', '')"
SQL_FUNCTIONS = {
    "url_host": ("STRING", _part(2)),
    "url_path": ("STRING", _PATH),
    "base_domain": ("STRING", f"substring_index({_part(2)}, '.', -2)"),
    "normalize_url": (
        "STRING",
        f"concat(lower(regexp_extract(url, {_raw('^((?:[^:/?#]+:)?(?://[^/?#]*)?)')}, 1)),"
        f" regexp_replace({_part(3)}, {_raw('^(.+)/(;[^/]*)?$')}, '$1$2'),"
        f" if({_part(4)} = '', '', concat('?', {_part(4)})))",
    ),
    "is_trash_media": ("BOOLEAN", f"rlike(lower({_PATH}), {_raw(any_of(K.TRASH_EXTENSIONS) + '$')})"),
}


def register_functions(spark: SparkSession) -> list[str]:
    """Create the functions in this session; they are SQL expressions, not Python."""
    for name, (kind, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(url STRING) RETURNS {kind} RETURN {body}")
    return list(SQL_FUNCTIONS)
