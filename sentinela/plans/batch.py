"""The batch analysis job as one Spark application.

read → clean/validate (F9) → derive (P2–P8) → k-means (M4) → isolation forest
(M8) → risk model (M10) → write (S5).  Rows of a file get a key after the
de-duplication; the derived table is settled once and each model adds its label
column in place.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame

from sentinela import constants as K
from sentinela.ml.anomaly import isolation_forest
from sentinela.ml.classify import train_risk_model
from sentinela.ml.cluster import kmeans, silhouette
from sentinela.operators.clean import clean_and_validate, fill_unknown
from sentinela.operators.derive import derive_time_features
from sentinela.operators.risk import risk_tier
from sentinela.plans.hints import settled
from sentinela.sources.io import with_key


def score_and_label(df: DataFrame, as_of: datetime | None = None, k: int = 5, n_init: int = 10,
                    contamination: float = 0.05, model_type: str = "xgboost", cv_folds: int | None = 5,
                    out_path: str | None = None):
    """Returns (labelled table, metrics dict, risk model result)."""
    base = settled(with_key(fill_unknown(derive_time_features(clean_and_validate(df, as_of=as_of)))))
    labelled, _feats, _km = kmeans(base, k=k, n_init=n_init)
    sil = silhouette(labelled)
    labelled = isolation_forest(labelled.drop("features"), [K.LAT, K.LON, "hora"], contamination)
    labelled = settled(risk_tier(labelled))
    result = train_risk_model(labelled, model_type, cv_folds=cv_folds)
    metrics = {"silhouette_sq": sil, "cv_mean": result.cv_mean, "cv_std": result.cv_std,
               "rows": float(labelled.count())}
    if out_path:
        from sentinela.sources.io import write_results
        write_results(labelled, out_path, metrics)
    return labelled, metrics, result
