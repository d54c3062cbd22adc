"""Entity records: documents seen, confidence, event ledger.

Defined results: rows without an entity are left out; a repeated event counts once; an entity without events has none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.baseline import snapshot

#: Documents after which an entity's baselines are trusted.
TRUSTED = 10


def records(docs: DataFrame, key: str = "doc_id", entity: str = "entity_id") -> DataFrame:
    """entity, documents, confidence = min(1, documents / TRUSTED)."""
    n = docs.filter(F.col(entity).isNotNull()).groupBy(entity).agg(F.countDistinct(key).alias("documents"))
    return n.withColumn("confidence", F.round(F.least(F.lit(1.0), F.col("documents") / TRUSTED) + 1e-9, 4))


def ledger(events: DataFrame, requests: DataFrame, entity: str = "entity_id") -> DataFrame:
    """entity, trigger_type, conclusion, events, worst: the events of an entity's requests."""
    owner = requests.filter(F.col(entity).isNotNull()).select("request_id", entity).distinct()
    e = events.select("event_id", "request_id", "trigger_type", F.col("algorithmic_conclusion").alias("conclusion"), "delta_score", *(["ingested_at"] if "ingested_at" in events.columns else []))
    # of several versions of an event the one taken in last counts
    version = F.struct(*[c for c in ("ingested_at", "request_id", "trigger_type", "conclusion", "delta_score") if c in e.columns])
    e = e.groupBy("event_id").agg(F.max_by(F.struct("request_id", "trigger_type", "conclusion", "delta_score"), version).alias("e")).select("event_id", "e.*")
    return e.join(owner, "request_id").groupBy(entity, "trigger_type", "conclusion").agg(F.count("*").alias("events"), F.max("delta_score").alias("worst"))


def baselines(scores: DataFrame, entity: str = "entity_id", variable: str = "variable", value: str = "value") -> DataFrame:
    """entity, variable, n, mu, sigma: the state that is stored with an entity, rounded to six places."""
    out = snapshot(scores.filter(F.col(entity).isNotNull()), [entity, variable], value)
    return out.withColumns({c: F.round(F.col(c) + 1e-9, 6) for c in ("mu", "sigma")})


def append(ledger_: DataFrame, new: DataFrame) -> DataFrame:
    """A ledger of single events (event_id) with new ones; an event that is there already isn't entered again."""
    return ledger_.unionByName(new.dropDuplicates(["event_id"]).join(ledger_.select("event_id"), "event_id", "left_anti"))


def cleared(ledger_: DataFrame) -> DataFrame:
    """The empty ledger."""
    return ledger_.limit(0)
