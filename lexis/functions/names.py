"""Run-name helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_model_name(name) -> tuple[Column, Column]:
    """Split at the first ``-`` into (model, embedding); no ``-`` gives a null embedding."""
    name = F.col(name) if isinstance(name, str) else name
    parts = F.split(name, "-", 2)
    return F.get(parts, 0), F.get(parts, 1)


def run_name(model, embedding) -> Column:
    """K8 naming: ``model-embedding``, or ``model`` when the embedding is empty/null."""
    model = F.col(model) if isinstance(model, str) else model
    embedding = F.col(embedding) if isinstance(embedding, str) else embedding
    return F.when(F.coalesce(embedding, F.lit("")) == "", model).otherwise(
        F.concat_ws("-", model, embedding))
