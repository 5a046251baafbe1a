"""Held-out accuracy of the learned operators on the synthetic tables, where they are present."""

import os

import numpy as np
import pytest

from lexiloom.llm import language_id, quality

TABLES = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables")


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{TABLES}/{n}.parquet") for n in ("documents", "labels"))
    rows = quality.digest(docs, labels).where("held_out").join(labels.where("quality is not null"), "doc_id").collect()
    y, score, predicted = (np.array([r[c] for r in rows]) for c in ("quality", "score", "predicted"))
    good, bad = score[y == 1], score[y == 0]
    auc = (good[:, None] > bad).mean() + (good[:, None] == bad).mean() / 2
    assert len(rows) > 50 and auc > 0.98 and (predicted == y).mean() > 0.95


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    rows = language_id.digest(docs).where("held_out").join(docs.where("lang is not null").select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) > 150 and np.mean([r.lang_pred == r.lang for r in rows]) > 0.97
